"""Forms around whole pages, lists of links inside articles, text beside the best container, deep nesting."""

import time

import pytest

from corpusmill.llm.html_text import main_text

ONE, TWO = ("Real words, here. " * 20).strip(), ("More of them, there. " * 20).strip()
STORY, TEXT = f"<h1>Title</h1><p>{ONE}</p><p>{TWO}</p>", f"Title\n{ONE}\n{TWO}"
SHORT = "A short second section, of one sentence."


@pytest.mark.parametrize("tag", ["form", "fieldset"])
def test_a_form_around_the_page_stays(tag):
    controls = "<input type=hidden value=x><label>Search</label><input><button>Go</button><select><option>One</select><textarea>a, b, c</textarea>"
    assert main_text(f"<body><{tag} id=aspnetForm>{controls}<div>{STORY}</div></{tag}></body>") == TEXT
    assert main_text(f"<{tag}><nav><a href=x>Menu</a></nav><article>{STORY}</article>{controls}</{tag}>") == TEXT
    assert main_text(f"<{tag}><div class=menu>{'<a href=x>Home of links</a>' * 200}</div><div>{STORY}</div></{tag}>") == TEXT
    assert main_text(f"<{tag}><main>{STORY}</main><{tag}><p>Your name, please.</p></{tag}></{tag}>") == TEXT


@pytest.mark.parametrize("tag", ["form", "fieldset"])
def test_a_form_beside_or_in_the_article_goes(tag):
    assert main_text(f"<article>{STORY}<{tag}><p>Subscribe now, to our letter.</p><input></{tag}></article>") == TEXT
    assert main_text(f"<div>{STORY}</div><{tag}><p>Write to us, and say what you think of it.</p></{tag}>") == TEXT
    assert main_text(f"<{tag}><p>Log in with your name and password.</p><input></{tag}>") == ""
    assert main_text(f"<{tag} class=search><p>Find what you look for, in all our pages.</p></{tag}><main><p>y</p></main>") == "y"


def test_links_inside_the_article_stay():
    sources = "<ul><li><a href=a>Source one</a><li><a href=b>Source two</a></ul>"
    table = "<table><tr><td><a href=a>Cell</a><td><a href=b>Other</a></table>"
    assert main_text(f"<article>{STORY}{sources}{table}</article>") == f"{TEXT}\nSource one\nSource two\nCell\nOther"
    assert main_text(f"<div>{STORY}{sources}<p>{ONE}</p></div>") == f"{TEXT}\nSource one\nSource two\n{ONE}"


def test_menus_go():
    menu = "<ul><li><a href=x>Home</a><li><a href=y>News</a></ul>"
    assert main_text(f"<article><ul class=menu><li><a href=x>Home</a></ul>{STORY}</article>") == TEXT
    # A container that nothing marks: lists of links before and behind all paragraphs are menus.
    assert main_text(f"<body>{menu}<h1>Title</h1><p>{ONE}</p><p>{TWO}</p>{menu}</body>") == TEXT


def test_text_beside_the_best_container_stays():
    lead = "A lead sentence that stands alone here."
    assert main_text(f"<div>{lead}<div><p>{ONE}</p><p>{TWO}</p></div></div>") == f"{lead}\n{ONE}\n{TWO}"
    for tag in ("section", "div"):
        page = f"<{tag}><h2>A</h2><p>{ONE * 3}</p></{tag}><{tag}><h2>B</h2><p>{SHORT}</p></{tag}>"
        assert main_text(f"<div>{page}</div>") == main_text(f"<main>{page}</main>") == f"A\n{ONE * 3}\nB\n{SHORT}"


def test_labels_and_notices_beside_it_go():
    assert main_text(f"<div>Menu<div><p>{ONE}</p></div><div>© us, all rights reserved by the company.</div></div>") == ONE
    assert main_text(f"<div><div><p>{ONE}</p></div><div class=sidebar><p>{SHORT}</p></div></div>") == ONE
    assert main_text(f"<div><div><p>{ONE}</p></div><div><p><a href=x>{SHORT}</a></p></div></div>") == ONE


@pytest.mark.parametrize("page,least", [
    ("<div>" * 20_000 + f"<p>{ONE}</p>", len(ONE)), ("".join(f"<div>Level {i}, and more. " for i in range(20_000)), 300_000),
    ("<span>" * 20_000 + ONE, len(ONE)), ("<div class=widget>" * 5000 + f"<p>{ONE}</p>", 0), ("<p>a, b" * 30_000, 100_000),
    ("<form>" * 5000 + f"<p>{ONE}</p>", len(ONE)), ("<div class=post>x, y. <div class=nav>z, w. " * 3000, 0), ("<li>" * 20_000 + ONE, len(ONE)),
])
def test_depth_costs_no_square(page, least):
    start = time.time()
    assert len(main_text(page)) >= least
    assert time.time() - start < 5
