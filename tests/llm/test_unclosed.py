"""Elements that are no raw text and have no end tag."""

import pytest

from corpusmill.llm import html_text


@pytest.mark.parametrize("tag", "video audio object canvas svg math select template".split())
def test_the_rest_of_the_page_stays(tag):
    page = f"<article><p>One, two.</p><div><{tag} class=x></div><p>Three, four.</p></article>"
    assert html_text.main_text(page) == "One, two.\nThree, four."
    assert html_text.main_text(page.replace("</div>", f"<b>no</b></{tag}></div>")) == "One, two.\nThree, four."


def test_self_closed_drawings():
    assert html_text.main_text("<article><p>One <svg/>two</p></article>") == "One two"


def test_raw_text_reaches_to_the_end():
    assert html_text.main_text("<article><p>One</p><script>var x</article><p>no</p>") == "One"


def test_sources_stay():
    page = "<article><p>Read, this, and that.</p><ol><li>Smith, J.: <a href=a>A title of some length</a>, 2020</li></ol></article>"
    assert html_text.main_text(page) == "Read, this, and that.\nSmith, J.: A title of some length, 2020"
