"""The training-data operators on small fixtures: brute force, round trips, and odd rows."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayspans.llm import components, exact_topk, html_extraction, jaccard_join, mixing, packing, pii, quality_classifier, quality_rules, toxicity, warc
from dayspans.llm._common import stash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row string, k string, idx int, votes string, score double"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DATA = "/root/testdata/sf0.001"


def odd_rows():
    """Nulls everywhere, empty and long texts, repeats, ties, words of all kinds, and columns that clash with inner names."""
    rng = random.Random(7)
    words = ["alpha", "beta", "Gamma", "delta", "épsilon", "zeta", "a.b@c.de", "+1 (988) 555-2485", "4111 1111 1111 1111", "10.0.0.300", "1.2.3.4", "#tag", "x|y"]
    base = " ".join(rng.choice(words) for _ in range(80))
    texts = [None, "", "   \n\t ", "one", "One", "a b c", base, base, base.upper(), base + " more", base.replace("alpha", "omega", 1), "x " * 3000, "\x1c odd\x85 space  here", "<|endoftext|> text", "퟿ é 😀 " * 20]
    texts += [" ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    rows = [(i if i % 11 else None, t, "en", f"s{i % 4}" if i % 5 else None, 1, 5, "r", "k", 3, "v", 0.5) for i, t in enumerate(texts)]
    return rows + rows[6:9] + rows[20:22]


@pytest.fixture(scope="module")
def docs(spark):
    return stash(spark.createDataFrame(odd_rows(), SCHEMA).repartition(3), "odd")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def n_words(t):
    return len(WORD.findall(t or ""))


# 1 Mixing


def water_fill(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total > cap * sizes[s]]
        if not over:
            return out | {s: left * w[s] / total for s in free}
        for s in over:
            out[s] = cap * sizes[s]
        left -= sum(out[s] for s in over)
        free -= set(over)
    return out


def test_mix_meets_its_targets(docs):
    m = mixing.mix(docs, block_words=16)
    got = m.documents.collect()
    sizes = defaultdict(int)
    for r in odd_rows():
        sizes[r[3]] += n_words(r[1])
    want = water_fill(sizes)
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6
        taken[r["source"]] += r["taken"]
    assert len(got) == len(odd_rows())
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    slots = m.schedule.groupBy("slot", "idx", "rank").agg(F.sum("words").alias("n")).collect()
    assert all(r["n"] <= 16 for r in slots) and sum(r["n"] < 16 for r in slots) <= len(sizes)


def test_mix_interleaves_sources_evenly(docs):
    order = [r["idx"] for r in mixing.mix(docs, block_words=4).schedule.select("slot", "idx").distinct().orderBy("slot").collect()]
    share = Counter(order)
    for n in range(20, len(order), 20):
        head = Counter(order[:n])
        assert all(abs(head[s] - n * share[s] / len(order)) <= 5 for s in share)


def test_ranks_of_points(spark):
    bits = mixing.BITS
    point = lambda i: int(f"{i:0{bits}b}"[::-1], 2)
    lo, hi = int(0.21 * 2**bits), int(0.37 * 2**bits)
    d = spark.range(200).withColumn("u", F.expr(mixing.point("id"))).select("id", "u", F.expr(mixing.points_below("id", "u", f"{hi}L")).alias("h"), F.expr(mixing.points_below("id", "u", f"{lo}L")).alias("l"))
    for r in d.collect():
        assert r["u"] == point(r["id"])
        assert r["h"] - r["l"] == sum(lo <= point(j) < hi for j in range(r["id"]))


def test_mix_reruns_agree_and_empty(docs, nothing):
    rows = lambda: sorted(map(str, mixing.mix(docs).documents.select("doc_id", "size", "taken").collect()))
    assert rows() == rows()
    assert mixing.mix(nothing).documents.count() == 0 and mixing.mixed_documents(nothing).count() == 0


def test_mixed_documents(docs):
    m = mixing.mixed_documents(docs)
    assert m.columns == docs.columns
    assert m.count() == mixing.mix(docs).documents.agg(F.sum("copies")).first()[0]


# 2 PII


def base_spans(t):
    out = []
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for rank, (k, p) in enumerate(kinds.items()):
        for m in re.finditer(p, t or ""):
            v, d = m.group(), re.sub("[^0-9]", "", m.group())
            if k == "ip" and any(int(x) > 255 for x in v.split(".")) or k == "phone" and not 9 <= len(d) <= 15:
                continue
            if k == "card" and (not 12 <= len(d) <= 19 or sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(d))) % 10):
                continue
            out.append((m.start(), rank, m.end(), k))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_pii_matches_brute_force(spark, docs, nothing):
    more = ["a@b.c@d.e", "a@b.c_d@e.f x@y", "1.2.3.4.5 999.1.1.1 0001.002.3.0255", "é😀 4111-1111-1111-1111 +1 +2", "a@b" + ".c" * 3000, "9" * 4000, "x" * 9000, "a@b.co " * 400, "12 34-56 78 90 12 34 56"]
    d = docs.select("doc_id", "text").union(spark.createDataFrame([(900 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    found = pii.detect(d).select("text", pii.joined(F.filter("pii", lambda s: s["rank"] < 4)).alias("b")).collect()
    assert [r["b"] for r in found] == [base_spans(r["text"]) for r in found]
    assert pii.detect(nothing).count() == 0


def test_pii_added_kinds_and_mask(spark):
    d = spark.createDataFrame([(1, "é my iban GB82 WEST 1234 5698 7654 32, call +1 (269) 555-3296 4524132264652876 ok"), (2, "serial GB82 WEST 1234 5698 7654 33"), (3, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r["text"] for r in pii.redact(d).collect()}
    assert rows[3] is None and rows[2] == "serial GB82 WEST 1234 5698 7654 33"
    assert rows[1].startswith("é my iban <IBAN>, call <TEL> ") and "3296" not in rows[1]


# 4 HTML


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("<p>", ""), ("a &amp b &am", "a & b &am"),
    ("<nav>menu</nav><article><h1>T</h1><p><b>One.<br><p>Two,  three\n<i>four</i>.</p><form>f</form><div class='comments'><p>c</p></div></article><footer>x</footer>", "T\nOne.\nTwo, three four."),
    ("<body><div id=sidebar>s</div><div><p>Long text, with commas. And more of it.</p><p>On.</p><script>var t='</p>';</script></div><div class=ad>buy</div>", "Long text, with commas. And more of it.\nOn."),
    ("<main><ul><li>a<li>b</ul><table><tr><td>1<td>2</table></main>", "a\nb\n1\n2"),
])
def test_main_text(page, text):
    assert html_extraction.main_text(page) == text


def test_extract_reads_given_pages(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    import html as entities

    for r in html_extraction.extract(pages).collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S).group(1)
        parts = (" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner))
        assert r["text"] == "\n".join(x for x in parts if x)


STORY = [f"Paragraph {i} of the story is long, has commas, and says several things. It goes on for a while; then, at last, it ends." for i in range(4)]
TEASERS = "".join(f"<article><h3>Teaser {i}</h3><p>Read more here.</p></article>" for i in range(6))


def paragraphs(lines):
    return "".join(f"<p>{x}</p>" for x in lines)


@pytest.mark.parametrize(("page", "lines"), [
    (f"<body><div><h1>Title</h1>{paragraphs(STORY)}</div><div>{TEASERS}</div></body>", ["Title", *STORY]),
    (f"<body><div>{TEASERS}</div>\n<div>\n<h1>Title</h1>\n{paragraphs(STORY)}</div></body>", ["Title", *STORY]),
    (f"<body><div><h1>Title</h1>{paragraphs(STORY[:2])}<article><h3>Card</h3><p>Buy.</p></article>{paragraphs(STORY[2:])}</div></body>", ["Title", *STORY]),
    (f"<body><article><h1>A</h1>{paragraphs(STORY[:3])}</article><article><h1>B</h1>{paragraphs(STORY[3:])}</article></body>", ["A", *STORY[:3], "B", STORY[3]]),
    (f"<body><article><h1>A</h1>{paragraphs(STORY)}</article>{TEASERS}</body>", ["A", *STORY]),
    (f"<body><main><article><h1>A</h1>{paragraphs(STORY)}</article><div><div>Short.</div></div></main></body>", ["A", *STORY]),
    (f"<body><div><div><h1>A</h1>{paragraphs(STORY[:1])}</div><ul><li>one<li>two</ul><section>{paragraphs(STORY[1:])}<div>Note.</div></section></div><div>Top</div></body>", ["A", STORY[0], "one", "two", *STORY[1:], "Note."]),
    (f"<body><div>{paragraphs(x.replace('story', '<a>st</a>o<b>r</b>y') for x in STORY)}</div>{TEASERS}</body>", STORY),
])
def test_main_text_is_selected_by_path_ratios(page, lines):
    assert html_extraction.main_text(page).split("\n") == lines


@pytest.mark.parametrize(("page", "lines"), [
    (f"<body><div class='content has-sidebar'>{paragraphs(STORY)}</div><div class='sidebar'><p>Side.</p></div></body>", STORY),
    (f"<body><div>{paragraphs(STORY)}<p title='a hidden gem'>A hidden gem, it says.</p><div hidden=''><p>Not seen.</p></div><p style='display: none'>Nor this.</p></div></body>", [*STORY, "A hidden gem, it says."]),
    ("<div>" * 400 + f"<nav>Menu</nav>{paragraphs(STORY)}<div class='related'><p>Read next</p></div>" + "</div>" * 400, STORY),
    (f"<body><article>{paragraphs(STORY[:1])}</article><article>One.</article><article>{paragraphs(STORY[1:])}</article></body>", [STORY[0], *STORY[1:]]),
])
def test_main_text_marks_and_depth(page, lines):
    assert html_extraction.main_text(page).split("\n") == lines


def test_extract_odd_tables(spark):
    rows = [(1, None, "u", "t", 5), (2, "", "u", "t", 5), (3, f"<p>{STORY[0]}</p>", "u", "t", 5), (3, f"<p>{STORY[0]}</p>", "u", "t", 5), (None, "<p>x</p>", None, None, None)]
    d = spark.createDataFrame(rows, "page_id long, html string, url string, text string, block int")
    got = html_extraction.extract(d)
    assert got.columns == d.columns and Counter((r["page_id"], r["text"], r["block"]) for r in got.collect()) == Counter({(1, "", 5): 1, (2, "", 5): 1, (3, STORY[0], 5): 2, (None, "x", None): 1})
    assert html_extraction.extract(d.where("false")).count() == 0


def test_path_ratios_run_on_pages_with_an_article(monkeypatch):
    seen = []
    run = html_extraction.content_nodes
    monkeypatch.setattr(html_extraction, "content_nodes", lambda found: seen.append(1) or run(found))
    assert html_extraction.main_text(f"<article>{paragraphs(STORY)}</article>") == "\n".join(STORY) and seen


def test_extract_deep_and_broken_pages():
    assert html_extraction.main_text("<div>" * 5000 + "x") == "x" and html_extraction.main_text("<b>x" * 50_000) == "x" * 50_000
    for page in ( "<p" * 3000, '<p a="' * 300, "<b>x" * 3000, "</div>" * 3000, "<!--" * 1000):
        html_extraction.main_text(page)


@pytest.mark.parametrize("page", [
    "<body><script>for(i=0;i<n;i++){x(i)}</script><article>%s</article></body>",
    "<body><script>if(a<b){s='it'}</script><article>%s</article></body>",
    "<style>a<b{}</style><textarea>a<b \"</textarea><div>%s</div>",
    "<body><article>%s</article><article class='comment'><p>I liked it, really. Great stuff, thank you.</p></article></body>",
    "<body><article class='related teaser'><p>Another story, read on. It is good.</p></article><main>%s</main></body>",
    "<body><div class='article-body comments-enabled'>%s</div><div class='comments'><p>First, as ever. Ha, ha.</p></div></body>",
    "<body><div class='main-side'>%s</div><div class='side'><p>More, to the side. Yes.</p></div></body>",
    "<body><div class='story share'>%s</div><div class='share'><p>Share it, please. Do.</p></div></body>",
    "<body><form action='x'><div class='page header'><div>%s</div></div><input></form></body>",
    "<body><div>%s</div><form><p>Get our letter, free of charge. We send it daily.</p></form></body>",
    "<article>%s</article><div class='comments'>" + "<p>A reader writes, at length, that all this is known. And so on.</p>" * 60 + "</div>",
    "<body><div title=it's>%s</div></body>",
    "<body><p title='never ended>%s</body>",
    "<!--><div>%s</div><!-- a <b> --!><nav>m</nav>",
])
def test_main_text_keeps_the_story(page):
    assert html_extraction.main_text(page % paragraphs(STORY)) == "\n".join(STORY)


@pytest.mark.parametrize("part", ["<a x", '<a x="', "<a x='\" ", "<", "<!--", "<!", "<![CDATA[", "</b>", "</", "<b><div>", "<li></li>", "<p><span>", "<script>", "<div class=ad>"])
def test_broken_tags_take_linear_time(part):
    import time

    took = []
    for n in (20_000, 100_000):
        began = time.perf_counter()
        html_extraction.main_text("<ul><li>" + "<center>" * n * (part == "<li></li>") + part * n + '"')
        took.append(time.perf_counter() - began)
    assert took[1] < 1 or took[1] < 12 * took[0]


def test_path_scores_match_brute_force():
    rng = random.Random(14)
    shapes = {"p": "<p>{}</p>", "dp": "<div><p>{}</p></div>", "li": "<ul><li>{}</li></ul>", "sp": "<section><p>{}</p></section>", "d": "<div>{}</div>"}
    for _ in range(60):
        units = [(rng.choice(list(shapes)), "".join(rng.choice("abc  .,") for _ in range(rng.randrange(1, 90))).strip() or "x", i) for i in range(rng.randrange(1, 25))]
        found = list(html_extraction.nodes("".join(shapes[k].format(t) for k, t, _ in units)))
        assert [t for t, _, _ in found] == [t for _, t, _ in units]
        per = {k: [(len(t), len(re.findall("[.,]", t))) for x, t, _ in units if x == k] for k in shapes}
        mean = {k: [sum(c) / len(v) for c in zip(*v)] for k, v in per.items() if v}
        near = [[units[j][0] for j in (i - 1, i, i + 1) if 0 <= j < len(units)] for i in range(len(units))]
        fused = [sum(mean[k][0] for k in ks) / len(ks) * (1 + sum(mean[k][1] for k in ks) / len(ks)) for ks in near]
        score = {k: sum(f for f, u in zip(fused, units) if u[0] == k) / len(per[k]) for k in mean}
        least = 0.3 * sum(score[u[0]] * len(u[1]) for u in units) / sum(len(u[1]) for u in units)
        assert html_extraction.content_nodes(found) == {i for i, u in enumerate(units) if score[u[0]] >= least}


# 5 Jaccard join


def brute_components(rows, width, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(lower))
        k = min(width, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            o = len(a & sets[j])
            if o and 100 * o >= percent * (len(a) + len(sets[j]) - o):
                up[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)].append(d)
    return [(d, len(s), min(ids[find(i)], default=None) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def near_copies(rng, n_groups=12, n_each=12):
    words = [f"w{i}" for i in range(400)]
    rows, shared = [], [rng.choice(words) for _ in range(60)]
    for g in range(n_groups):
        base = [rng.choice(words) for _ in range(rng.randrange(30, 120))] + shared * (g % 3)
        for _ in range(n_each):
            t = list(base)
            for _ in range(rng.randrange(0, 6)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((len(rows), " ".join(t)))
    return rows


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_similarity_join_matches_brute_force(spark, docs, width, percent):
    rows = near_copies(random.Random(width)) + [(10_000 + i if r[0] is not None else None, r[1]) for i, r in enumerate(odd_rows())]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = jaccard_join.similarity_join(d, width=width, percent=percent).collect()
    assert Counter(map(tuple, got)) == Counter(brute_components(rows, width, percent))


def brute_links(rows, width, percent):
    lower, sets = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), []
    for _, t in rows:
        w = WORD.findall((t or "").translate(lower))
        k = min(width, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    same = lambda i, j: sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    return [(d, sum(1 for j in range(len(rows)) if j != i and same(i, j))) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("block", [4, 512])
def test_link_counts_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = near_copies(random.Random(8), 6, 12) + [(10_000 + i if r[0] is not None else None, r[1]) for i, r in enumerate(odd_rows())]
    got = jaccard_join.link_counts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), width=3, percent=60).collect()
    assert Counter(map(tuple, got)) == Counter(brute_links(rows, 3, 60)) and any(r["n_links"] > 1 for r in got)


def test_hot_texts_meet_by_broadcast(spark, monkeypatch):
    from dayspans.llm import _common

    monkeypatch.setattr(_common, "HOT_ROWS", 3)
    rows = near_copies(random.Random(9), 3, 8) + [(500 + i, "one text that very many rows share word by word") for i in range(40)] + [(600 + i, f"one text that very many rows share word by word {i % 2}") for i in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard_join.similarity_join(d, width=2, percent=70).collect()
    assert Counter(map(tuple, got)) == Counter(brute_components(rows, 2, 70))
    assert {r["doc_id"] for r in jaccard_join.one_per_group(d, width=2, percent=70).collect()} == {c for _, _, c in brute_components(rows, 2, 70)}


def test_exact_search_in_small_blocks(spark, monkeypatch):
    """With tiny blocks and chunks, the same result: heavy lists, block pairs and pure blocks all come into play."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    monkeypatch.setattr(jaccard_join, "CHUNK", 500)
    monkeypatch.setattr(jaccard_join, "RANGE", 100)
    rows = near_copies(random.Random(3), 6, 30)
    got = jaccard_join.similarity_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), width=2, percent=70).collect()
    assert Counter(map(tuple, got)) == Counter(brute_components(rows, 2, 70))


def test_occurrence_search_finds_every_component():
    import pandas as pd

    rng = random.Random(1)
    sets = [set(rng.sample(range(60), 40)) for _ in range(40)]
    group = pd.DataFrame({"k": [bytes([i]) for i in range(40)], "n": [40] * 40, "shared": [np.array(sorted(s)) for s in sets], "comp": [bytes([i]) for i in range(40)], "side": 1})
    links = jaccard_join.occurrence_search(60)(group)
    up = {bytes([i]): bytes([i]) for i in range(40)}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links.itertuples(index=False):
        up[find(a)] = find(b)
    for i in range(40):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if 100 * o >= 60 * (80 - o):
                assert find(bytes([i])) == find(bytes([j]))


def test_one_per_group(spark, docs, nothing):
    kept = jaccard_join.one_per_group(docs, width=5, percent=80)
    assert kept.columns == docs.columns
    groups = Counter(c for _, n, c in brute_components([(r[0], r[1]) for r in odd_rows()], 5, 80) if n)
    worded = [r for r in kept.collect() if n_words(r["text"])]
    named = [g for g in groups if g is not None]
    assert sorted(r["doc_id"] for r in worded if r["doc_id"] is not None) == sorted(named)
    assert kept.where(F.coalesce(F.trim("text"), F.lit("")) == "").count() == docs.where(F.coalesce(F.trim("text"), F.lit("")) == "").count()
    assert jaccard_join.similarity_join(nothing).count() == 0 and jaccard_join.one_per_group(nothing).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(30)] + [(100 + i, 100) for i in range(1, 40)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    up = {n: n for e in edges for n in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for a, b in edges if a != b for n in (a, b)}


# 3 and 6 Quality


def test_quality_rules_match_brute_force(docs, nothing):
    for r in quality_rules.assess(docs).collect():
        t, m = r["text"] or "", r["rules"]
        w = WORD.findall(t)
        win = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        rep = {j for i in range(len(w) - 7) if win[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(rep))
        assert (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"]) == want
        assert m["base_failed"] == (len(w) < 20 or 100 * len(rep) > 30 * len(w)) and not (m["kept"] and m["base_failed"])
    assert quality_rules.assess(nothing).count() == 0


def test_quality_rules_verdict_matches_brute_force(spark, docs):
    import zstandard

    c = zstandard.ZstdCompressor(level=quality_rules.LEVEL, write_content_size=False)
    more = spark.read.parquet(f"{DATA}/documents.parquet").select("text")
    seen = set()
    for r in quality_rules.assess(docs.select("text").union(more)).collect():
        data, m = (r["text"] or "").encode(), r["rules"]
        inside = lambda part: next((low, high) for upto, low, high in quality_rules.BANDS if len(part) <= upto)
        fits = lambda part: inside(part)[0] <= len(part) / len(c.compress(part)) <= inside(part)[1]
        chunks = [data[i : i + quality_rules.CHUNK] for i in range(0, len(data), quality_rules.CHUNK)]
        kept = not m["base_failed"] and fits(data) and sum(not fits(x) for x in chunks) <= quality_rules.OUT_SHARE * len(chunks)
        assert m["kept"] == kept
        seen.add((m["base_failed"], kept))
    assert len(seen) == 3


def test_quality_rules_take_their_limits_from_the_corpus(spark):
    rng = random.Random(41)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(25, 200))) for _ in range(1500)]
    texts += [texts[0]] * 900 + [None, "", "x", "y " * 20_000]  # very many copies of one text count once
    docs = quality_rules.measured(spark.createDataFrame([(t,) for t in texts], "text string").withColumn("text_hash", F.xxhash64("text")))
    rows = {r["text"]: r["measures"] for r in docs.collect()}
    want = []
    for i, (upto, low, high) in enumerate(quality_rules.BANDS):
        least = quality_rules.BANDS[i - 1][0] if i else 0
        own = sorted(round(m["ratio"], 3) for t, m in rows.items() if t and least < m["size"] <= upto)
        if len(own) >= quality_rules.LEAST_TEXTS:
            q1, q2, q3 = (next(r for k, r in enumerate(own) if k + 1 >= q * len(own)) for q in (0.25, 0.5, 0.75))
            width = max(q3 - q1, quality_rules.LEAST_RANGE * q2)
            low, high = (q1 - quality_rules.BELOW * width if low else 0.0), q3 + quality_rules.ABOVE * width
        want.append((upto, low, high))
    got = quality_rules.corpus_bands(docs)
    assert np.allclose(got, want) and sum(a != b for a, b in zip(got, quality_rules.BANDS)) >= 3
    verdict = quality_rules.judged(docs, got).select("text", "rules.*").collect()
    own = [b[0] for b, d in zip(got, quality_rules.BANDS) if b != d]
    mine = [r["kept"] for r in verdict if not r["base_failed"] and next(b[0] for b in got if len((r["text"] or "").encode()) <= b[0]) in own]
    assert len(mine) > 2000 and sum(mine) >= 0.99 * len(mine)
    assert quality_rules.corpus_bands(docs.where("false")) == quality_rules.BANDS


def test_quality_rules_keep_prose(spark):
    d = spark.read.parquet(f"{DATA}/documents.parquet").join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").where("quality = 1")
    m = quality_rules.assess(d).select("rules.*").where("not base_failed")
    assert m.where("kept").count() >= 0.98 * m.count()


def test_quality_rules_reject_what_is_random_or_repeats(spark):
    import base64

    rng = random.Random(11)

    def lines(text, width):
        return "\n".join(text[i : i + width] for i in range(0, len(text), width))

    rows = [(f"base64 {n}", lines(base64.b64encode(rng.randbytes(n * 3 // 4)).decode(), 76)) for n in (1700, 2500, 4000, 7000, 30_000)]
    rows += [(f"hex {n}", lines(rng.randbytes(n // 2).hex(), 64)) for n in (3500, 7000, 30_000)]
    rows += [(f"phrase {n}", " ".join(f"{rng.choice(['we', 'you'])} are very happy to see you all" for _ in range(n // 32))) for n in (1000, 4000, 30_000)]
    prose = spark.read.parquet(f"{DATA}/documents.parquet").join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").where("quality = 1").select("text").collect()
    long = "\n".join(r["text"] for r in prose if 400 < len(r["text"]) < 3000)
    rows.append(("half base64", long[:8192] + "\n" + lines(base64.b64encode(rng.randbytes(7000)).decode(), 76)))
    m = {r["name"]: r["rules"] for r in quality_rules.assess(spark.createDataFrame(rows, "name string, text string")).collect()}
    assert not [k for k, r in m.items() if r["kept"]]
    assert not m["base64 4000"]["base_failed"] and not m["hex 7000"]["base_failed"]


def test_quality_rules_keep_prose_of_every_length(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("quality = 1")
    m = quality_rules.assess(d).where("not rules.base_failed").withColumn("band", F.floor(F.log2(F.octet_length("text"))))
    assert all(r["n"] < 20 or r["kept"] >= 0.98 * r["n"] for r in m.groupBy("band").agg(F.count("*").alias("n"), F.count_if("rules.kept").alias("kept")).collect())


def test_em_matches_brute_force(spark):
    """Document by document in plain Python, for a few rounds, and by the patterns' table."""
    import math

    rng = random.Random(51)
    rows = [[rng.choice([-1, 0, 1]) if rng.random() < 0.3 else (1 if i % 4 else -1) for _ in quality_classifier.LABELLERS] for i in range(120)]
    start = quality_classifier.start_table()
    share, table = [quality_classifier.SHARE_GOOD, 1 - quality_classifier.SHARE_GOOD], start
    balance, b = list(share), quality_classifier.BELIEF
    for _ in range(quality_classifier.EM_ROUNDS):
        weight, cells = [0.0, 0.0], np.zeros(start.shape)
        for v in rows:
            logs = [math.log(share[c]) + sum(math.log(table[j, c, x + 1]) for j, x in enumerate(v)) for c in (0, 1)]
            p = [1 / (1 + math.exp(logs[1 - c] - logs[c])) if logs[1 - c] - logs[c] < 700 else 0.0 for c in (0, 1)]
            for c in (0, 1):
                weight[c] += p[c]
                for j, x in enumerate(v):
                    cells[j, c, x + 1] += p[c]
        share = [(weight[c] + b * balance[c]) / (len(rows) + b) for c in (0, 1)]
        table = cells + b * start
        table = table / table.sum(2, keepdims=True)
    counted = Counter(map(tuple, rows))
    frame = spark.createDataFrame([(list(v), n) for v, n in counted.items()], "votes array<int>, n long").repartition(5)
    got = quality_classifier.estimated(frame)
    assert np.allclose(got[0], share) and np.allclose(got[1], table) and 0.6 < got[0][0] < 0.9
    assert quality_classifier.estimated(frame.where("false")) is None


def test_quality_classifier_agrees_with_labels(spark, nothing):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 5000")
    w, share, table = quality_classifier.train(d)
    assert abs(share.sum() - 1) < 1e-9 and np.allclose(table.sum(2), 1, atol=1e-2)
    p = quality_classifier.score(d, w).join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").select("quality", "quality_score").toPandas()
    assert (p[p.quality == 1].quality_score >= 0.5).mean() > 0.97 and (p[p.quality == 0].quality_score < 0.5).mean() > 0.8
    assert quality_classifier.score(nothing, quality_classifier.train(nothing)[0]).count() == 0


def test_quality_classifier_odd_rows(docs):
    w, _, _ = quality_classifier.train(docs)
    assert all(0 <= r["quality_score"] <= 1 for r in quality_classifier.score(docs, w).collect())


# 7 Packing


@pytest.fixture(scope="module")
def files():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_both_encoders_agree(spark, files):
    slow, fast = packing.encoder(files[0]), packing.encoder(*files)
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()] + [r[1] or "" for r in odd_rows()]
    assert all(np.array_equal(slow(t), fast(t)) for t in texts)


def test_long_runs_take_the_ids_of_the_tokenizer(spark, files):
    slow, fast = packing.encoder(files[0]), packing.encoder(*files)
    runs = ["x" + " " * 1_000_000 + "y", "x" + "\n" * 1_000_000 + "y", "abcdefghij" * 100_000, "word " * 200_000]
    assert all(np.array_equal(slow(t), fast(t)) for t in runs)
    got = packing.pack(spark.createDataFrame(list(enumerate(runs)), "doc_id long, text string"), tokenizer=files[0], ranks=files[1], keep_ids=False)
    want = {(i, len(slow(t)) + 1, zlib.crc32(slow(t)[: (len(slow(t)) + 1 - 1) % 1024 + 1].tobytes())) for i, t in enumerate(runs) if len(slow(t)) % 1024 != 0}
    found = got.groupBy("doc_id").agg(F.sum("length").alias("n"), F.min(F.struct("piece", "ids_crc32"))["ids_crc32"].alias("crc")).collect()
    assert want <= {(r["doc_id"], r["n"], r["crc"]) for r in found} and len(found) == 4


def test_pack_round_trip(docs, nothing, files):
    got = packing.pack(docs, tokenizer=files[0], ranks=files[1], most=64).collect()
    bins = defaultdict(list)
    for r in got:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        bins[r["sequence_id"]].append(r)
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    encode, want = packing.encoder(files[0]), Counter()
    for r in odd_rows():
        ids = [*encode(r[1] or "").tolist(), packing.END]
        for p, (s, n) in enumerate(packing.cut(len(ids), 64)):
            want[(r[0], p, s, tuple(ids[s : s + n]))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], tuple(r["ids"])) for r in got) == want
    assert packing.pack(nothing, tokenizer=files[0]).count() == 0


def test_fullest_matches_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(rng.randrange(1, 6))}
        room, sums = rng.randrange(0, 60), {0}
        for k, n in counts.items():
            for _ in range(n):
                sums |= {s + k for s in sums if s + k <= room}
        got = packing.fullest(counts, room)
        assert sum(got) == max(sums) and all(got.count(k) <= counts[k] for k in set(got))


def test_fill_uses_every_piece_and_few_bins():
    rng = random.Random(4)
    h = Counter(rng.randrange(1, 1025) for _ in range(5000))
    out = packing.fill(dict(h), 1024)
    used = Counter()
    for items, times in out:
        assert sum(items) <= 1024
        for k in items:
            used[k] += times
    assert used == h and sum(t for _, t in out) <= 1.02 * sum(k * n for k, n in h.items()) / 1024


# 8 WARC


def test_warc_round_trip(spark):
    evil = "dup\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"
    rows = [(1, "http://www.A.com:80/x?q=1", "one"), (2, "https://a.com/x", evil), (3, None, evil), (4, "u\r\nX: y", None), (5, "u", ""), (9, "u", "é😀"), (7, "u", "é😀"), (7, "u", "é😀"), (None, "v", "n"), (None, "w", "n"), (11, "http://b.org/", "long " * 50_000)]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, digest string, bytes int")
    got = warc.capture_histories(pages).collect()
    assert len(got) == len(rows)
    b32 = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got) == Counter((i, len((t or "").encode()), b32(t)) for i, _, t in rows)
    kinds = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got)
    assert kinds == Counter({(1, "response", None): 1, (2, "response", None): 1, (3, "revisit", 2): 1, (4, "response", None): 1, (5, "revisit", 4): 1, (7, "response", None): 1, (7, "revisit", 7): 1, (9, "revisit", 7): 1, (None, "response", None): 1, (None, "revisit", None): 1, (11, "response", None): 1})
    keys = [(r["url_key"], r["captured_at"]) for r in got]
    assert [k for _, k in sorted(zip((r["place"] for r in got), keys))] == sorted(keys) and sorted(r["place"] for r in got) == list(range(len(rows)))
    assert warc.capture_histories(pages.where("false")).count() == 0


def test_warc_many_runs_and_ranges(spark, monkeypatch):
    """Small files and ranges: the merged order is the order of all captures, whatever the ids and the pages' lengths."""
    monkeypatch.setattr(warc, "FILE_BYTES", 8192)
    monkeypatch.setattr(warc, "MERGE_ROWS", 20)
    rng = random.Random(12)
    rows = [(rng.randrange(-(1 << 62), 1 << 62), f"http://{rng.choice('abc')}.org/{rng.randrange(4)}", "x" * rng.randrange(3000)) for _ in range(150)]
    rows += [((1 << 63) - 1, "http://a.org/1", "y"), (None, None, None)]
    pages = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, place int, part int").repartition(7)
    got = warc.capture_histories(pages).orderBy("place").collect()
    keys = [(r["url_key"], r["captured_at"], r["page_id"] is not None, r["page_id"] or 0) for r in got]
    assert keys == sorted(keys) and [r["place"] for r in got] == list(range(len(rows)))
    assert len({r["run"] for r in got}) > 20 and Counter(r["page_id"] for r in got) == Counter(r[0] for r in rows)


def test_a_very_long_page_takes_one_file_more(spark, tmp_path):
    import os

    files = lambda d: [f for _, _, names in os.walk(d) for f in names if f.startswith("part-")]
    rows = [(i, f"http://a.org/{i}", f"page {i}") for i in range(400)]
    frame = lambda r: spark.createDataFrame(r, "page_id long, url string, html string").repartition(2)
    warc.write_archives(frame(rows), f"{tmp_path}/few")
    warc.write_archives(frame([*rows, (400, "http://a.org/0", "x" * (65 << 20))]), f"{tmp_path}/long")
    assert len(files(f"{tmp_path}/few")) == 2 and len(files(f"{tmp_path}/long")) == 3
    got = warc.read_archives(spark, f"{tmp_path}/long").select("page_id", "payload_bytes").collect()
    assert Counter(map(tuple, got)) == Counter([(i, len(h)) for i, _, h in rows] + [(400, 65 << 20)])


@pytest.mark.parametrize("lookup", [50_000, 0])
def test_warc_spreads_hot_payloads(spark, monkeypatch, lookup):
    """Very many copies of one payload, and of one row: the same records whether first ids are broadcast or joined."""
    from dayspans.llm import _common

    monkeypatch.setattr(warc, "BROADCAST_ROWS", lookup)
    monkeypatch.setattr(_common, "HOT_ROWS", 50)
    rows = [(1000 + i, "http://hot.org/", "hot") for i in range(3000)] + [(i, "u", f"cold {i % 40}") for i in range(100)] + [(7, "u", "again")] * 900
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    got = warc.capture_histories(pages).groupBy("record_type", "refers_to").count().collect()
    want = Counter({("response", None): 42, ("revisit", 1000): 2999, ("revisit", 7): 2 + 899})
    want.update({("revisit", i): 1 + (i < 20) for i in range(40) if i != 7})
    want["revisit", 7] = 899 + 2
    assert {(r["record_type"], r["refers_to"]): r["count"] for r in got} == dict(want)


def test_loser_tree():
    rng = random.Random(0)
    for k in range(0, 9):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(0, 20))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


# 9 Toxicity


def test_toxicity_learns_planted_words(spark, nothing):
    rng = random.Random(9)
    plain, bad = [f"wo{i}rd" for i in range(300)], ["idiot", "scumbag", "loserling"]
    rows, labels = [], []
    for i in range(900):
        w = [rng.choice(plain) for _ in range(rng.randrange(10, 120))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, known)
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % toxicity.FOLDS == 0]
    assert sum((got[i] >= 0.5) == (i % 4 == 0) for i in held) >= 0.95 * len(held)
    assert toxicity.score(nothing, model).count() == 0
    flat = toxicity.train(nothing, known)
    assert all(r["toxicity"] < 0.5 for r in toxicity.score(docs.limit(5), flat).collect())


def test_toxicity_windows_and_thresholds_match_brute_force():
    import zstandard

    rng = random.Random(31)
    plain, bad = [f"wo{i}rd" for i in range(200)], ["idiot", "scumbag"]
    texts = [" ".join(rng.choice(bad if rng.random() < 0.1 * (i % 2) else plain) for _ in range(rng.randrange(5, 90))) for i in range(300)]
    sets = [np.unique(toxicity.codes(t)) for t in texts]
    toxic, ordinary = toxicity.trained(sets[1::2], 4_000), toxicity.trained(sets[::2], 16_000)
    found = toxicity.comparer(toxic, ordinary)
    for t in texts[:40]:
        words, want = t.split(), []
        for i in range(0, len(words), toxicity.WINDOW):
            data = b"".join(np.array(c, "<u8").tobytes() for c in toxicity.codes(" ".join(words[i : i + toxicity.WINDOW])))
            length = lambda d: len(zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False).compress(data))  # noqa: B023, E731
            want.append(length(ordinary) - length(toxic + ordinary))
        assert found(t).tolist() == want
    d, y = [found(t) for t in texts], [i % 2 for i in range(300)]
    quiet, least, worth = toxicity.calibrate(d, y)
    assert quiet == np.quantile([v for x, own in zip(d, y) if not own for v in x], toxicity.QUIET)
    excess = [sum(max(v - quiet, 0) for v in x) / (toxicity.MORE + len(x)) for x in d]
    value = lambda t: sum(e >= t for e, own in zip(excess, y) if own) / 150 - toxicity.ALARM * sum(e >= t for e, own in zip(excess, y) if not own) / 150
    assert abs(value(least) - worth) < 1e-9 and worth >= max(value(t) for t in excess) - 1e-9 and worth > 0.5
    assert toxicity.calibrate(d[::2], y[::2])[1] == float("inf")  # one class alone
    blind = toxicity.comparer(b"", b"")  # without what zstandard learned no text stands out
    assert not any(blind(t).any() for t in texts)


def test_toxicity_holds_bounded_bytes(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "HELD_BYTES", 60_000)
    rows = [(i, ("idiot " if i % 2 else "") + " ".join(f"w{j * (i + 1)}" for j in range(60))) for i in range(200)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, known)).collect()
    assert len(got) == 200 and all(0 <= r["toxicity"] <= 1 for r in got)


def test_toxicity_odd_rows(spark, docs):
    known = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, known)).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r["toxicity"] <= 1 for r in got)


# 10 Top-k


def brute_topk(rows, k, every):
    import math

    ok = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dims = max((len(v) for _, v in ok), default=0)
    ok = [(i, v + [0] * (dims - len(v))) for i, v in ok]
    out = Counter()
    for q in sorted({i for i, _ in ok if i is not None and i % every == 0}):
        best = []
        for _, v in (r for r in ok if r[0] == q):
            best += [(-sum(a * b for a, b in zip(v, c)), i is None, i) for i, c in ok if i != q]
        for n, (s, _, i) in enumerate(sorted(best, key=lambda x: (x[0], x[1], x[2] or 0))[:k]):
            out[(q, n + 1, i, -s)] += 1
    return out


@pytest.mark.parametrize("block", [8, 8192])
def test_topk_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(exact_topk, "BLOCK_BYTES", block * 8 * 6)
    monkeypatch.setattr(exact_topk, "QUERY_BYTES", 3 * 8 * 6)
    monkeypatch.setattr(exact_topk, "CELL", 2)
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=6) * rng.choice([0.1, 1, 3])).astype("f4").tolist()) for i in range(60)]
    rows += [(60, None), (61, [1.0, None]), (62, [float("nan")] * 6), (63, [float("inf")] * 6), (64, [1.0, 2.0]), (65, []), (None, [5.0] * 6), (None, [5.0] * 6), (66, rows[3][1]), (67, rows[3][1]), (68, [0.0] * 6)]
    d = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, norm int, x string")
    got = Counter(map(tuple, exact_topk.top_k(d, k=4, every=5).collect()))
    assert got == brute_topk(rows, 4, 5)


def test_topk_takes_large_vectors_or_says_so(spark):
    rows = [(0, [1 / 1024, 0.0]), (1, [float(1 << 41), 0.0]), (2, [-float(1 << 40), 3.0]), (3, [1.0, 1.0])]
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = Counter(map(tuple, exact_topk.top_k(frame(rows), k=4, every=100).collect()))
    assert got == brute_topk(rows, 4, 100) and (0, 1, 1, 1 << 51) in got
    for big in (float(1 << 60), 1e300):
        with pytest.raises(ValueError, match="may not fit a long"):
            exact_topk.top_k(frame([*rows, (100, [big, 0.0])]))


def test_topk_without_rows(spark):
    d = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert exact_topk.top_k(d).count() == 0
    one = spark.createDataFrame([(100, [1.0])], "vec_id long, embedding array<float>")
    assert exact_topk.top_k(one).count() == 0
