"""Pages whose wrappers name a layout or a topic."""

import pytest

from corpusmill.llm import html_text

ONE, TWO = ("Real words, here. " * 20).strip(), ("More of them, there. " * 20).strip()
STORY = f"<h1>Title</h1><p>{ONE}</p><p>{TWO}</p>"
TEXT = f"Title\n{ONE}\n{TWO}"
ASIDE = "<div class=sidebar><p>Other things, told aside.</p></div>"


@pytest.mark.parametrize("name", ["content with-sidebar", "page no-sidebar", "site has-banner", "post type-post tag-news entry", "content sidebar-right",
                                  "sidebar-layout", "legal", "page tag-news", "comments"])
def test_wrapper_keeps_the_article(name):
    assert html_text.main_text(f"<body><div class='{name}'>{STORY}</div></body>") == TEXT
    if name != "comments":
        assert html_text.main_text(f"<div class=top><a href=x>Home</a></div><div class='{name}'>{STORY}{ASIDE}</div><div>© us</div>") == TEXT


def test_main_inside_a_named_wrapper():
    assert html_text.main_text(f"<div class='nav-drawer'><div class=menu><a href=x>Home</a></div><main>{STORY}</main></div>") == TEXT


def test_article_cut_into_named_parts():
    parts = "".join(f"<div class='box-widget'><p>{t}</p></div>" for t in (ONE, TWO))
    assert html_text.main_text(f"<div class=page>{parts}</div>") == f"{ONE}\n{TWO}"


def test_named_parts_still_go():
    long = "<p>" + "I think, so too. " * 60 + "</p>"
    assert html_text.main_text(f"<article>{STORY}</article><div class=comments>{long}</div>") == TEXT
    assert html_text.main_text(f"<body><div>{STORY}</div><div class=comments>{long * 9}</div></body>") == TEXT
    assert html_text.main_text(f"<div class='post tag-cloud'>{STORY}<ul class=tag-list><li><a href=x>a tag</a></ul></div>") == TEXT
    assert html_text.main_text(f"<article><p>{ONE} <span class=share>Share this</span></p></article>") == ONE
    assert html_text.main_text(f"<div id=sidebar><div class=text>{long}</div></div><div class=post-content>{STORY}</div>") == TEXT
