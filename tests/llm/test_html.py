"""Main texts of pages made with a known article: containers of several kinds, neighbours, menus without telling names, broken markup."""

import itertools
import random

import pytest

from quillstone.llm.html import main_text

from .data import words


def sentence(rng, n=14):
    return ", ".join([words(rng, n // 2), words(rng, n - n // 2)]).capitalize() + "."


def links(rng, tag="li"):
    return "".join(f'<{tag}><a href="/x{k}">{words(rng, 3)}</a></{tag}>' for k in range(8))


#: The article's holder, without a telling name, and what stands around it.
HOLDERS = ["<div>{}</div>", "<section class='body-text'>{}</section>", "<table><tr><td>{}</td></tr></table>", "<div><div id='x1'>{}</div></div>", "<main>{}</main>", "<article>{}</article>"]
AROUND = ["{}", "<ul>{links}</ul>{}", "{}<div>{links}</div>", "<div class='sidebar'><p>{junk}</p></div>{}", "{}<footer><p>{junk}</p></footer>", "{}<div class='comments'><p>{junk}</p><p>{junk}</p></div>"]


@pytest.mark.parametrize("k", range(len(HOLDERS) * len(AROUND)))
def test_article_of_a_made_page(k):
    rng = random.Random(k)
    holder, around = list(itertools.product(HOLDERS, AROUND))[k]
    said = [sentence(rng, rng.randint(20, 60)) for _ in range(rng.randint(3, 7))]
    inner = "".join(f"<p>{t}</p>" for t in said)
    page = f"<html><head><title>{words(rng, 4)}</title><style>p {{}}</style></head><body>" + around.replace("{links}", links(rng)).replace("{junk}", sentence(rng, 30)).replace("{}", holder.format(inner), 1) + "<script>var a = '<p>no</p>';</script></body></html>"
    assert main_text(page) == " ".join(said)


def test_siblings_of_the_best_container():
    rng = random.Random(3)
    a, b, c, d = (sentence(rng, 40) for _ in range(4))
    short = "Read on."
    # two containers alike are kept, a list of links and a short line beside them are not
    page = f"<body><div><div><p>{a}</p><p>{b}</p></div><div><p>{c}</p><p>{d}</p></div><p>{short}</p><ul>{links(rng)}</ul></div></body>"
    assert main_text(page) == " ".join([a, b, c, d])
    # a long plain paragraph beside the container is kept
    page = f"<body><div><div><p>{a}</p><p>{b}</p><p>{c}</p></div><p>{d}</p></div></body>"
    assert main_text(page) == " ".join([a, b, c, d])


def test_link_density_decides_between_containers():
    rng = random.Random(4)
    a, b = sentence(rng, 40), sentence(rng, 40)
    linked = "".join(f'<p><a href="/y">{sentence(rng, 60)}</a></p>' for _ in range(4))
    assert main_text(f"<body><div>{linked}</div><div><p>{a}</p><p>{b}</p></div></body>") == f"{a} {b}"


@pytest.mark.parametrize("tag", ["button", "select", "video", "object", "iframe", "script", "svg"])
def test_an_element_never_closed_takes_itself_only(tag):
    rng = random.Random(5)
    a, b = sentence(rng, 40), sentence(rng, 40)
    assert main_text(f"<article><p>{a}</p><{tag}>x = 1<p>{b}</p></article>") == f"{a} {b}"


def test_equal_scores_take_the_first():
    rng = random.Random(6)
    a = sentence(rng, 40)
    assert main_text(f"<body><section><div><p>{a}</p></div></section><section><div><p>{a}</p></div></section></body>") in (a, f"{a} {a}")
    assert main_text("") == "" and main_text(None) == ""


@pytest.mark.parametrize("attributes", ["class='content has-sidebar'", "class='main no-comments'", "id='article-share-page'", "class='page with-nav without-header'", "class='postWidgetArea'", "class='sidebar'", "id='is-modal'", "class='hide-menu post'"])
@pytest.mark.parametrize("inside", ["<p>{}</p><p>{}</p><p>{}</p>", "<ul><li>{}</li><li>{}</li></ul><p>{}</p>", "<p>{}</p><pre>{}</pre><blockquote>{}</blockquote>", "<div><p>{}</p></div><p>{}</p><ol><li>{}</li></ol>"])
def test_names_are_evidence_that_text_outweighs(attributes, inside):
    rng = random.Random(attributes + inside)
    said = [sentence(rng, n) for n in (60, 50, 40)]
    page = f"<body><ul>{links(rng)}</ul><div {attributes}>{inside.format(*said)}</div><div class='footer'><p>{sentence(rng, 8)}</p></div></body>"
    assert main_text(page) == " ".join(said)


@pytest.mark.parametrize("holder", ["<div class='comments'>{}</div>", "<section id='comment-list'>{}</section>", "<div class='post-replies'>{}</div>", "<ol class='commentlist comments'><li>{}</li></ol>"])
def test_long_comments_are_none_of_the_article(holder):
    rng = random.Random(holder)
    a, b = sentence(rng, 40), sentence(rng, 30)
    junk = "".join(f"<p>{sentence(rng, 40)}</p>" for _ in range(6))
    assert main_text(f"<body><div><p>{a}</p><p>{b}</p></div>{holder.format(junk)}</body>") == f"{a} {b}"


@pytest.mark.parametrize("inside", ["<ul><li>{}</li><li>{}</li></ul><p>{}</p>", "<p>{}</p><ol><li>{}</li><li>{}</li></ol>", "<blockquote><p>{}</p><p>{}</p></blockquote><p>{}</p>", "<p>{}</p><table><tr><td>{}</td></tr><tr><td>{}</td></tr></table>", "<pre>{}</pre><p>{}</p><dl><dd>{}</dd></dl>"])
@pytest.mark.parametrize("sizes", [(60, 60, 8), (8, 60, 60), (30, 8, 60)])
def test_lists_and_quotations_are_parts(inside, sizes):
    rng = random.Random(inside)
    said = [sentence(rng, n) for n in sizes]
    assert main_text(f"<body><div><ul>{links(rng)}</ul></div><div class='post'>{inside.format(*said)}</div></body>") == " ".join(said)


@pytest.mark.parametrize("code", ["var a=1; if (a<2) { x(\"</p>\") }", "var x='</p>'", "document.write('<p>no</p><div>no</div>')", "x = \"<div class='a'>\" + `<p>\n</p>`", "// it's fine", "a < b && c > d"])
def test_code_never_closed_is_no_text(code):
    rng = random.Random(8)
    a, b = sentence(rng, 40), sentence(rng, 40)
    assert main_text(f"<article><p>{a}</p><p>{b}</p></article><script>{code}") == f"{a} {b}"
    assert main_text(f"<article><p>{a}</p><script>{code}\n<p>{b}</p></article>") == f"{a} {b}"
    assert main_text(f"<script>{code}") == ""
