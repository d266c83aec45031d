import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators import chunks, retrieval, sections, web


def values(spark, column, rows, schema="t string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(column).collect()]


def test_text_functions(spark):
    t = F.col("t")
    assert values(spark, tx.normalize_name(t), [" Water-Temp (C) ", "__a  b--c__", "é", None]) == [
        "water_temp_c", "a_b_c", "", None]
    assert values(spark, tx.normalize_text(t), [" A\u00a0 b\n\tC\u3000", None]) == ["a b c", None]
    ranges = ["6.0-7.5", "0-255", "-5-10", "0 to 1000", "50-80 typical", "±4096", "", None, "1e-3-5",
              "5-6f", "a-b", "1-2-3"]
    got = [None if r is None else tuple(r) for r in values(spark, tx.parse_range(t), ranges)]
    assert got == [(6.0, 7.5), (0.0, 255.0), (-5.0, 10.0), None, None, None, None, None, (0.001, 5.0),
                   None, None, None]
    assert values(spark, tx.range_midpoint(t), [
        "6.0-7.5", "-5-10", "0 to 1000", "21 to 23 seconds", "±4096", "warm", "", None]) == [
        6.75, 7.5, 500.0, 22.0, 4096.0, None, None, None]
    assert values(spark, tx.valid_section(t), ["2.1", "2.1.", "0.16", "1.06", "21.1", "1.31", "20.30", "x", "1"]) == [
        True, True, False, False, False, False, True, False, False]


def pack_reference(text, limit, delimiter):
    if len(text) // 4 <= limit:
        return [text]
    parts, held, tokens = [], [], 0
    for p in text.split(delimiter):
        n = len(p) // 4
        if held and tokens + n > limit:
            parts.append(delimiter.join(held))
            held, tokens = [], 0
        held.append(p)
        tokens += n
    parts.append(delimiter.join(held))
    return [s for p in parts for s in (
        [p[i:i + limit * 4] for i in range(0, len(p), limit * 4)] if len(p) // 4 > limit else [p])]


def test_pack_text(spark):
    rng = random.Random(4)
    texts = ["", "short", "x" * 500, "\n\n" * 40, "a\n\n" + "b" * 900 + "\n\nc"]
    texts += ["\n\n".join("w" * rng.randint(0, 90) for _ in range(rng.randint(1, 40))) for _ in range(40)]
    got = values(spark, tx_pack(25), texts)
    assert got == [pack_reference(t, 25, "\n\n") for t in texts]


def tx_pack(limit):
    return chunks.pack_text(F.col("t"), limit)


def test_small_parts_are_dropped_but_counted(spark):
    raw = spark.createDataFrame([("s", "n", "guide", "general", "general", "x" * 119),
                                 ("s", "m", "guide", "general", "general", "y" * 120)],
                                "source string, name string, chunk_type string, domain string, pattern string, text string")
    out = chunks.make_chunks(raw, "manual").collect()
    assert [(r.name, r.part) for r in out] == [("m", 0)]
    assert chunks.missing_metadata(chunks.make_chunks(raw, "manual")).count() == 0


def test_dedupe_keeps_first(spark):
    df = spark.createDataFrame([(1, " A  b"), (2, "a B"), (3, " \n"), (4, None), (5, "c")], "i int, text string")
    assert sorted(r.i for r in chunks.dedupe_chunks(df, "i").collect()) == [1, 5]


def test_upsert_is_idempotent(spark):
    schema = "chunk_id string, text string, framework string, domain string, type string, pattern string, source string, v int"
    base = spark.createDataFrame([("a", "1", *"fdtps", 1), ("b", "1", *"fdtps", 1)], schema)
    new = spark.createDataFrame([("b", "2", *"fdtps", 2), ("b", "3", *"fdtps", 3), ("c", "1", *"fdtps", 1)], schema)
    once = chunks.upsert(base, new, "v")
    twice = chunks.upsert(once, new, "v")
    assert sorted(once.collect()) == sorted(twice.collect())
    assert {r.chunk_id: r.text for r in once.collect()} == {"a": "1", "b": "3", "c": "1"}
    broken = spark.createDataFrame([("d", "1", None, *"dtps", 1)], schema)
    with pytest.raises(Exception, match="required metadata"):
        chunks.upsert(base, broken, "v").collect()


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_top_k_equals_brute_force(spark, metric, monkeypatch):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(300, 8))
    vectors[50:60] = vectors[0]  # equal vectors: the id decides
    groups = rng.integers(0, 3, 300)
    queries = rng.normal(size=(7, 8))
    wanted = [0, 1, 2, None, 0, None, 1]
    c = spark.createDataFrame([(i, v.tolist(), int(g)) for i, (v, g) in enumerate(zip(vectors, groups))],
                              "chunk_id long, embedding array<double>, grp int").repartition(5)
    q = spark.createDataFrame([(i, v.tolist(), w) for i, (v, w) in enumerate(zip(queries, wanted))],
                              "query_id int, embedding array<double>, grp int")
    want = set()
    for i, v in enumerate(queries):
        if metric == "cosine":
            d = 1 - vectors @ v / np.linalg.norm(vectors, axis=1) / np.linalg.norm(v)
        else:
            d = ((vectors - v) ** 2).sum(axis=1)
        rows = sorted((round(x, 9), j) for j, x in enumerate(d) if wanted[i] is None or groups[j] == wanted[i])
        want |= {(i, j, r + 1) for r, (_, j) in enumerate(rows[:4])}
    for block in (10 ** 9, 20):  # 20 numbers per block: several query blocks
        monkeypatch.setattr(retrieval, "MAX_BLOCK_VALUES", block)
        out = retrieval.top_k(q, c, 4, ("grp",), metric).collect()
        assert {(r.query_id, r.chunk_id, r["rank"]) for r in out} == want


def scanned(spark, page, kind):
    found = sections.scan_pages(spark.createDataFrame([("d", 1, page)], "doc string, page_num long, text string"))
    return [(r.heading, r.target) for r in found.filter(found.kind == kind).orderBy("idx").collect()]


def heading(spark, page):
    return next((h for h, _ in scanned(spark, page, "scan")), None)


def test_zero_vectors_rank_last(spark):
    chunks = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "chunk_id long, embedding array<double>")
    queries = spark.createDataFrame([("q", [1.0, 0.0]), ("zero", [0.0, 0.0])], "query_id string, embedding array<double>")
    out = retrieval.top_k(queries, chunks, 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_id, r.distance) for r in out] == [
        ("q", 2, 0.0), ("q", 3, 1.0), ("q", 1, None), ("zero", 1, None), ("zero", 2, None), ("zero", 3, None)]


def test_contents_formats(spark):
    page = ("Contents\n1.1 General description . . . . 3\n1.2 PHYSICS   10\n2.1 Diffusion\t\n\n 12\n"
            "2.2 Wrapped title\nwith rest ..... 14\n0.16 Density   9\n3.1 Lost\nno page here\n21.1 Far   3")
    assert scanned(spark, page, "toc") == [
        ("1.1 General description", 3), ("1.2 PHYSICS", 10), ("2.1 Diffusion", 12),
        ("2.2 Wrapped title with rest", 14)]


def test_page_headings(spark):
    assert heading(spark, "intro\n2.1 Diffusion system\ntext") == "2.1 Diffusion system"
    assert heading(spark, "1.06 Density table\n0.16 Value here\nno") is None
    assert heading(spark, "2.1 Diffusion 14") is None  # short line with a page number
    assert heading(spark, "1.1 A ..... 3\n1.2 B ..... 4\n1.3 C ..... 5") is None
    left = ["Some long left column text here ", "3.2 Pump unit assembly overview", "more words on the left side now"]
    right = ["right column words follow here", "and again more right words", "4.4 Another heading right"]
    page = "\n".join(f"{a:<36}    {b}" for a, b in zip(left, right))
    split = spark.createDataFrame([(page,)], "text string").select(sections.split_columns(F.col("text")).alias("parts"))
    assert len(split.first().parts) == 2
    assert heading(spark, None) is None and heading(spark, "") is None
    assert heading(spark, page) == "3.2 Pump unit assembly overview"


def test_columns_split_until_none_splits(spark):
    def side_by_side(left, right, gap):
        width = max(map(len, left))
        return [f"{a:<{width}}{' ' * gap}{b}" for a, b in zip(left, right)]

    def words(tag):
        return [f"{tag}{i} some words of text" for i in range(4)]

    cells = [words(tag) for tag in "abcdef"]
    cells[4][1] = "7.2 Heading of fifth"
    cells[5][0] = "7.3 Heading of sixth"
    lines = cells[5]
    for cell, gap in zip(reversed(cells[:5]), (3, 6, 9, 12, 15)):
        lines = side_by_side(cell, lines, gap)
    contents = "\n".join(f"1.{i} Part ...... {i}" for i in range(1, 5))
    plain = "7.1 Plain heading\nwords   with gaps"
    pages = spark.createDataFrame([("d", 1, "\n".join(lines)), ("d", 2, contents), ("d", 3, plain), ("d", 4, None),
                                   ("d", 5, "")], "doc string, page_num long, text string")
    parts = sections.column_parts(pages, ["doc", "page_num"]).orderBy("path").collect()
    assert [(r.page_num, r.path) for r in parts] == [(1, p) for p in ("0", "10", "110", "1110", "11110", "11111")]
    assert [r.text.split("\n")[2].strip() for r in parts] == [cell[2] for cell in cells]
    found = {(r.page_num, r.heading) for r in sections.page_headings(pages).collect()}
    assert found == {(1, "7.2 Heading of fifth"), (3, "7.1 Plain heading")}
    assert sections.column_parts(pages.filter("page_num > 1"), ["doc", "page_num"]) is None
    assert sections.page_headings(pages.limit(0)).collect() == []


def test_widest_gap(spark):
    lines = ["a   b   c", "aa   bb     cc", "no gap", "x     y   zz      w", "", "tab   \tx"]
    found = spark.createDataFrame([(s,) for s in lines], "s string").select(sections.widest_gap(F.col("s")).alias("at"))
    assert [r.at for r in found.collect()] == [1, 7, None, 12, None, None]


def test_section_ranges(spark):
    starts = spark.createDataFrame(
        [("a", 0, 0, 1, "one"), ("a", 1, 0, 3, "two"), ("a", 2, 0, 3, "three"), ("a", 3, 0, 4, "four"),
         ("b", 0, 0, 2, "only")], "doc string, place long, idx long, start long, heading string")
    docs = spark.createDataFrame([("a", 24), ("b", 7), ("c", 5)], "doc string, total_pages long")
    want = [("a", 0, 0, 1, 2, "one"), ("a", 1, 0, 3, 3, "two"), ("a", 2, 0, 3, 3, "three"),
            ("a", 3, 0, 4, 11, "four [part 1]"), ("a", 3, 1, 12, 19, "four [part 2]"),
            ("a", 3, 2, 20, 24, "four [part 3]"), ("b", 0, 0, 1, 5, "pages_1_5"), ("b", 1, 0, 6, 7, "pages_6_7"),
            ("c", 0, 0, 1, 5, "pages_1_5")]
    for ranges in (1, 7):
        out = sections.section_ranges(starts, docs, ranges=ranges).collect()
        assert sorted(tuple(r) for r in out) == want


def html_text(html):
    return web._PageText().content(html)


def test_main_content():
    assert html_text("<nav>n</nav><p>a<b>b</b></p><!-- c -->d<footer>f</footer><script>x</script>") == "a\nb\nd"
    assert html_text("<p>out</p><article role='main'><p>in &amp; on</p><script>s</script></article>") == "in & on"
    assert html_text("<div class='x body'>b</div><main>m</main>") == "b"
    assert html_text("<main>m<p>k</main><p>o") == "m\nk"
    assert html_text("<div id='main-content'>i</div>") == "i"


def test_references_without_semicolon(spark):
    page = "<title>a&amp;&amp</title><p title='x&y'>b &lt &#65; &#65 &nosuch; &eacute;&co &amp;lt;</p>"
    pages = spark.createDataFrame([(1, page), (2, None)], "page_id int, html string")
    strict = {r.page_id: r.content for r in web.main_content(pages, bare_references=False).collect()}
    assert strict == {1: "a&&amp\nb &lt A &#65 &nosuch; é&co &lt;", 2: ""}
    assert web.main_content(pages.filter("page_id = 1")).first().content == "a&&\nb < A A &nosuch; é&co &lt;"


def test_guide_sections(spark):
    long = "x" * 120
    text = spark.createDataFrame([(f"Title\n{long}\n(note)\nSecond\nshort\nTHIRD LINE\n{long}",)], "text string")
    assert text.select(web.guide_sections(F.col("text")).alias("s")).first().s == [
        f"Title\n{long}\n(note)", f"short\nTHIRD LINE\n{long}"]
