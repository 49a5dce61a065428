"""Tag-path ratios (8): cost on broken markup, names of furniture, and a plain second computation of the ratios."""

import math
import random
import resource
import time

import numpy as np
import pytest

from cairn.llm import op8_html as op

PARAGRAPH = "<p>" + "The council met on Tuesday, and the members agreed, after a long debate, to rebuild the bridge. " * 3 + "</p>"
COOKIES = "<div class='%s'>We use cookies to improve the site. By going on you agree to them. Read the policy, please.</div>"

BROKEN = {
    "unmatched ends": "<b>" * 60_000 + "</i>" * 60_000,
    "unclosed blocks": "<div>word, text." * 60_000,
    "unclosed inline before paragraphs": "<b>" * 50_000 + "<p>a</p>" * 60_000,
    "open adverts": "<div class=ad>word, text" * 40_000,
    "articles in asides": "<aside><article>word, text." * 30_000,
    "long class names": "<div class='a b c d e f g h'>x" * 30_000,
}


@pytest.mark.parametrize("name", BROKEN)
def test_a_megabyte_of_broken_markup_is_cheap(name):
    page = BROKEN[name]
    before, start = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    op.main_text(page)
    assert time.time() - start < 6
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000


@pytest.mark.parametrize("name", ["cookie", "comments", "cookie-banner", "comment-list", "post-comments", "related-posts",
                                  "site-notice", "newsletter_signup box"])
@pytest.mark.parametrize("holder", ["<article>%s</article>", "<main>%s</main>", "<div id=content>%s</div>"])
def test_named_furniture_goes(name, holder):
    inside = holder % (PARAGRAPH * 3 + COOKIES % name + PARAGRAPH * 3)
    beside = holder % (PARAGRAPH * 6) + COOKIES % name
    for page in (inside, beside):
        got = op.main_text(f"<html><body>{page}</body></html>")
        assert got.count("Tuesday") == 18 and "cookies" not in got


@pytest.mark.parametrize("page", ["<div class='layout has-sidebar'><article>%s</article></div>",
                                  "<article class='post comments-open'>%s</article>", "<main class='no-sidebar'>%s</main>",
                                  "<article>%s</article>", "<div class='page-with-menu'>%s</div>",
                                  "<article><section id='related-work'>%s</section></article>",
                                  "<article><section class='client-side market-share'>%s</section></article>"])
def test_names_that_only_mention_furniture_stay(page):
    assert op.main_text(f"<html><body>{page % (PARAGRAPH * 6)}</body></html>").count("Tuesday") == 18


def plain_keep(nodes):
    """The ratios by their formulas: no article, list, link or named element on these pages."""
    real = [x for x in nodes if x.text.strip()]
    size = {id(x): len(x.text.strip()) for x in real}
    dots = {id(x): sum(c in ".,;:!?" for c in x.text) for x in real}

    def ratio(key):
        groups = {}
        for x in real:
            groups.setdefault(key(x), []).append(x)
        return {k: (sum(size[id(x)] for x in g) / len(g), sum(dots[id(x)] for x in g) / len(g)) for k, g in groups.items()}

    path, held = ratio(lambda x: x.path), ratio(lambda x: x.holder)
    value = [path[x.path][0] * (1 + math.log1p(path[x.path][1])) + held[x.holder][0] * (1 + math.log1p(held[x.holder][1]))
             for x in real]
    fused = []
    for i in range(len(real)):
        near = [(math.exp(-(i - j) ** 2 / (2 * op.WIDTH ** 2)), value[j])
                for j in range(max(0, i - op.REACH), min(len(real), i + op.REACH + 1))]
        fused.append(math.sqrt(value[i] * sum(w * v for w, v in near) / sum(w for w, _ in near)))
    total = sum(size.values())
    least = op.THRESHOLD * sum(f * size[id(x)] for f, x in zip(fused, real)) / total
    boxes = {}
    for f, x in zip(fused, real):
        a, b = boxes.get(x.place.box, (0.0, 0))
        boxes[x.place.box] = (a + f * size[id(x)], b + size[id(x)])
    good = {id(x) for f, x in zip(fused, real) if f >= least or boxes[x.place.box][0] >= least * boxes[x.place.box][1]}
    return [x.text for x in nodes if id(x) in good]


def test_ratios_equal_a_plain_computation():
    r = random.Random(12)
    for _ in range(60):
        parts = []
        for _ in range(r.randint(1, 12)):
            words = " ".join(r.choice(["word", "text,", "end.", "more;", "a"]) for _ in range(r.choice([1, 2, 8, 60, 200])))
            parts.append(r.choice(["<div>%s</div>", "<div><p>%s</p><p>short</p></div>", "<section><h2>%s</h2><b>x</b></section>",
                                   "<div><div><span>%s</span></div></div>", "%s"]) % words)
        nodes = op.text_nodes("<html><body>" + "".join(parts) + "</body></html>")
        want = plain_keep(nodes)
        got = [x.text for x, good in zip(nodes, op.keep_nodes(nodes)) if good and x.text.strip()]
        assert got == want


def test_path_numbers_are_paths():
    nodes = op.text_nodes("<div><p>a<b>c</b></p><p>d</p></div><div><p class=q>e</p></div>")
    by = {x.text: x for x in nodes}
    assert by["a"].path == by["d"].path != by["e"].path and by["a"].holder == by["c"].holder == by["e"].holder
    assert by["c"].path != by["a"].path
