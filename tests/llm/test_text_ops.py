"""Sharding (4), fingerprints (6), SimHash (7), HTML text (8), mixing (10) and the pipeline."""

import hashlib
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from cairn.llm import op4_sharding, op6_fingerprints, op7_simhash, op8_html, op10_mixing
from cairn.llm.common import components, scratch


def test_sharding(spark, documents, odd_rows):
    rows = odd_rows + [(1000 + i, "hot text") for i in range(300)]
    got = op4_sharding.shard(documents(rows), shards=5).collect()
    assert len(got) == len(rows)
    slots, shard_of = {}, {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        shard_of.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in shard_of.values())
    assert op4_sharding.shard(documents([])).count() == 0


def test_written_shards_hold_every_row_once(spark, documents, odd_rows):
    # two texts of one id with equal checksums, null ids, and one row many times
    rows = odd_rows + [(70, "plumless"), (70, "buckeroo"), (None, None), (None, "no id here")] + [(71, "again")] * 20
    path = scratch(spark, "test-shards")
    op4_sharding.write_shards(documents(rows), path, shards=5)
    got = spark.read.parquet(path).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or "")
    assert sorted([(r.doc_id, r.text) for r in got], key=key) == sorted(rows, key=key)
    slots, shard_of = {}, {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        shard_of.setdefault(r.text or "", set()).add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in shard_of.values())


def test_differencing_balances():
    r = random.Random(0)
    sizes = [r.randint(1, 10_000) for _ in range(2000)]
    sums = [0] * 7
    for s, p in zip(sizes, op4_sharding.karmarkar_karp(sizes, 7)):
        sums[p] += s
    assert max(sums) - min(sums) <= 10
    assert op4_sharding.karmarkar_karp([], 3) == [] and len(set(op4_sharding.karmarkar_karp([5, 5, 5], 3))) == 3


def test_fingerprints(spark, documents, odd_rows):
    rows = sorted([x for x in odd_rows if x[0] is not None and x[0] != 2], reverse=True)
    ids, texts = [i for i, _ in rows], [t or "" for _, t in rows]
    for per_range in (1000, 5):
        got = {r.doc_id: r for r in op6_fingerprints.compare_with_next(documents(rows), per_range).collect()}
        for k, i in enumerate(ids):
            t, after = texts[k], texts[(k + 1) % len(ids)]
            edited = t[:len(t) - len(t) // 2] + after[:len(t) // 2]
            mine, theirs = op6_fingerprints.fingerprints([t.encode()])[0], op6_fingerprints.fingerprints([edited.encode()])[0]
            assert (got[i].n_chars, got[i].fingerprint, got[i].edited_fingerprint) == (len(t), mine, theirs)
            assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert got[i].near_edited == op6_fingerprints.likeness([mine], [theirs])[0]
    assert op6_fingerprints.compare_with_next(documents([])).count() == 0
    assert op6_fingerprints.compare_with_next(documents(odd_rows)).count() == len(odd_rows)


def simple_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def simple_groups(prints, radius=4):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def near_copies():
    r = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    out = []
    for i in range(60):
        base = [r.choice(words) for _ in range(200)]
        for j in range(3):
            copy = list(base)
            for _ in range(j):
                copy[r.randrange(200)] = "changed"
            out.append((1000 * j + i, " ".join(copy)))
    return out + [(5000 + k, out[0][1]) for k in range(50)]


def test_simhash_against_all_pairs(spark, documents, odd_rows):
    rows = near_copies() + odd_rows
    prints = [simple_fingerprint(t) for _, t in rows]
    assert prints == [op7_simhash.fingerprint(t) for _, t in rows]
    groups, first = simple_groups(prints), {}
    for (i, _), g in zip(rows, groups):
        if i is not None:
            first[g] = min(first.get(g, i), i)
    want = sorted((i, first[g]) for (i, _), g in zip(rows, groups) if i is not None)
    got = op7_simhash.near_duplicates(documents(rows)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == want
    kept = op7_simhash.deduplicate(documents(rows))
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == sorted(first.values()) and "score" in kept.columns
    assert op7_simhash.near_duplicates(documents([])).count() == 0


def test_tree_shards_and_parts_lose_no_link(spark):
    r = np.random.default_rng(3)
    centres = r.integers(0, 2 ** 63, 40, dtype=np.uint64)
    points = [int(c) for c in centres]
    for c in centres.tolist() * 20:
        points.append(c ^ (1 << int(r.integers(64))) ^ (1 << int(r.integers(64))))
    points = sorted(set(points))
    signed = np.array(points, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = {x.node: x.component for x in
             components(op7_simhash.links(df, leaf=64, sample=200, block=50, ask_block=90)).collect()}
    groups = simple_groups(points)
    size = {g: groups.count(g) for g in groups}
    for p, g in zip(signed, groups):
        members = [s for s, h in zip(signed, groups) if h == g]
        assert found.get(p, p) == (min(members) if size[g] > 1 else p)


def test_html(spark):
    page = """<html><head><title>x</title></head><body><header><h1>Site</h1><a href=/>Home</a></header>
<div class="menu"><ul><li><a>One</a><li><a>Two</a></ul></div><div id=content><h2>Real Title</h2>
<p>First paragraph with <b>bold</b> and <a href="x">a link</a>, long enough to be &amp; counted as text.<p>Second one,
 also with words; and more words.</div><div class="comments"><p>Nice article, thanks a lot.</p></div>
<aside>Side</aside><form><input> Search</form><footer>c 2020</footer><script>x="</p>"</script></body>"""
    assert op8_html.main_text(page) == ("Real Title\n\nFirst paragraph with bold and a link, long enough to be & counted "
                                        "as text.\n\nSecond one, also with words; and more words.")
    rows = [(1, "u", page, "t"), (2, None, None, "t"), (3, "u", "", "t"), (4, "u", "just <b>text", "t"),
            (5, "u", "<p>" + "word, " * 50_000, "t"), (None, "u", "<p>cut <a href=\"x", "t")]
    got = op8_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [r.text for r in got][1:4] == ["", "", "just text"] and got[5].text == "cut"
    assert all(r.n_chars == len(r.text) for r in got) and got[4].n_chars == 50_000 * 6 - 1


def article_with(middle, around="<article>{}</article>", paragraphs=8):
    """A page whose text has ``middle`` among paragraphs of 400 characters with 4 marks."""
    p = "<p>" + ("a" * 99 + ".") * 4 + "</p>"
    text = "<h2>Heading of it</h2>" + p * (paragraphs // 2) + middle + p * (paragraphs - paragraphs // 2)
    return "<html><body><div><ul><li><a>Home</a><li><a>News</a></ul></div>" + around.format(text) + "</body></html>"


def test_html_keeps_short_nodes_of_an_article():
    def items(n, size):
        return [f"i{k}".ljust(size, "x") for k in range(n)]

    tables = {"list": lambda x: "<ul>" + "".join(f"<li>{s}</li>" for s in x) + "</ul>",
              "terms": lambda x: "<dl>" + "".join(f"<dt>{s}<dd>{s}z" for s in x) + "</dl>",
              "lines": lambda x: "".join(f"<p class=line>{s}</p>" for s in x),
              "table": lambda x: "<table>" + "".join(f"<tr>{''.join(f'<td>{s}</td>' for s in x[i:i + 4])}</tr>"
                                                    for i in range(0, len(x), 4)) + "</table>"}
    for around in ("<article>{}</article>", "<main><div>{}</div></main>", "<div id=content>{}</div>"):
        for n, size in ((12, 25), (5, 25), (12, 60), (24, 8)):
            for make in tables.values():
                got = op8_html.main_text(article_with(make(items(n, size)), around)).split("\n\n")
                assert [s for s in items(n, size) if s not in got] == []
                assert "Home" not in got and "News" not in got and got[0] == "Heading of it"
    links = "<ul>" + "".join(f"<li><a>{s}</a></li>" for s in items(12, 25)) + "</ul>"
    for around in ("<article>{}</article>", "<div id=content>{}</div>"):
        got = op8_html.main_text(article_with(links, around)).split("\n\n")
        assert [s for s in items(12, 25) if s not in got] == []
    after = "<article>{}" + tables["list"](items(5, 25)) + "</article>"
    assert op8_html.main_text(article_with("", after)).split("\n\n")[-5:] == items(5, 25)


def test_html_names_are_not_a_verdict():
    want = op8_html.main_text(article_with(""))
    body = "<article>{}</article>"
    holders = ("<div class='layout has-sidebar'>{}</div>", "<article class='post comments-open'>{}</article>",
               "<main class='no-sidebar'>{}</main>", "<section id='related-work'>{}</section>", "<form>{}</form>",
               "<div class='layout sidebar'>{}</div>", "<article class='tags share'>{}</article>",
               "<main id=comments>{}</main>", "<section id=related>{}</section>", "<form id=form1 role=form>{}</form>",
               "<form><div class='share'>{}</div></form>", "<div class=hidden>" + body + "</div>",
               "<form>" + body + "</form>", "<article><div class=widget>{}</div></article>",
               "<div class=notice><div class=widget><main>" + body + "</main></div></div>")
    others = ("<div class=comments>" + "<p>I like it, thanks a lot.</p>" * 5 + "</div><footer>Imprint, 2020.</footer>"
              "<aside class=related><article><a>Other</a> teaser, short.</article></aside><form>Search: <input></form>")
    for around in holders:
        for more in ("", others):
            got = op8_html.main_text(article_with("", around + more))
            assert got.endswith(want) and got[:len(got) - len(want)] in ("", "See more, here.\n\n"), around
    long = "<div class='comments'>" + ("<p>" + "My view of it, in short. " * 20 + "</p>") * 40 + "</div>"
    assert op8_html.main_text(article_with("", body + long)) == want


def test_mixing_meets_targets(spark, documents):
    rows = [(i, ("the cat of the hill, and " * (3 + i % 5)) if i % 4 else ("der Hund und die " * (3 + i % 3)))
            for i in range(800)] + [(900, None), (901, ""), (None, "the end, of it")]
    docs = documents(rows)
    labelled = spark.createDataFrame([(i, "en" if i % 4 else "de") for i in range(0, 800, 3)] + [(1, None)],
                                     "doc_id long, domain string")
    got = op10_mixing.mix(docs, labelled, {"en": 0.5, "de": 0.5}).collect()
    assert len(got) == len(rows) and all(abs(sum(r.posterior) - 1) < 1e-9 and r.rate >= 0 for r in got)
    n = sum(r.n_tokens for r in got)
    for k in range(2):
        assert abs(sum(r.n_tokens * r.rate * r.posterior[k] for r in got) / n - 0.5) < 0.02
    kept = op10_mixing.remix(docs, labelled, {"en": 0.5, "de": 0.5}, total=None, least_rate=1.0)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows}
    assert op10_mixing.mix(documents([]), labelled, {"en": 1.0}).count() == 0


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
        after = [(r.doc_id, r.text) for r in docs.collect()]
        if name == "near_duplicates":
            ids = sorted(before)
            groups = simple_groups([simple_fingerprint(before[i]) for i in ids])
            assert sorted(i for i, _ in after) == sorted({ids[g] for g in groups})
        assert {i for i, _ in after} <= set(before) and (name != "mixing" or {i for i, _ in after} == set(before))
        before = dict(after)
    assert docs.filter(F.col("doc_id").isNull()).count() == 0
