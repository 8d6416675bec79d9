import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from kairosift.functions import temporal as tmp
from kairosift.operators import blocks, chunks, lifecycle, represent, requests, routes
from kairosift.plans.more import ORACLE, QUERIES
from kairosift.sources import intake
from kairosift.streaming import runs

from test_retrieval import small_engine

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v if isinstance(v, (int, bool, type(None))) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def distinct_queries():
    seen, out = set(), []
    for name, sql in ORACLE.items():
        if sql not in seen:
            seen.add(sql)
            out.append(name)
    return out


@pytest.mark.parametrize("name", distinct_queries())
def test_query_against_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    at = [want.columns.index(c) for c in columns]
    a = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    b = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert a == b


@pytest.mark.parametrize(
    "text, precision, start, end",
    [
        ("founded in 509 BCE.", "YEAR", (-509, None, None), (None, None, None)),
        ("on 15 March 44 BCE he", "DAY", (-44, 3, 15), (None, None, None)),
        ("power from 27 BCE until 14 CE.", "RANGE", (-27, None, None), (14, None, None)),
        ("in the 1940s", "DECADE", (1940, None, None), (1949, None, None)),
        ("the 5th century BCE", "CENTURY", (-500, None, None), (-401, None, None)),
        ("in summer 1944", "SEASON", (1944, None, None), (None, None, None)),
        ("on 1944-06-06", "DAY", (1944, 6, 6), (None, None, None)),
        ("in March 1944", "MONTH", (1944, 3, None), (None, None, None)),
        ("two years later", "UNKNOWN", (None, None, None), (None, None, None)),
    ],
)
def test_recognized_dates(text, precision, start, end):
    (m,) = list(tmp.mentions(text))
    assert (m[3], m[5:8], m[8:11]) == (precision, start, end)
    assert text[m[0] : m[1]] == m[2]


def test_dates_that_are_none_and_hedges():
    assert list(tmp.mentions("March 15 was cold")) == []
    assert [list(tmp.mentions(t))[0][4] for t in ("in 1944", "c. 121 CE", "roughly 1944", "possibly 1944", "two years later")] == ["EXACT", "APPROXIMATE", "APPROXIMATE", "UNCERTAIN", "UNCERTAIN"]


MARKDOWN = "# Top\n\nFirst line\nsecond line\n\n## Middle\n- item one\n| a | b |\n| --- | --- |\n| c | d |\n\n```\nraw text\n```\n# Other\n\nlast"


def test_markdown_blocks(spark):
    docs = spark.createDataFrame([(1, MARKDOWN)], "doc_id long, text string")
    rows = [(r.type, r.text, r.level, list(r.section_path)) for r in blocks.markdown_blocks(docs).orderBy("block_id").collect()]
    assert rows == [
        ("HEADING", "Top", 1, []), ("PARAGRAPH", "First line second line", 1, ["Top"]), ("HEADING", "Middle", 2, ["Top"]),
        ("LIST_ITEM", "item one", 2, ["Top", "Middle"]), ("TABLE_TEXT", "| a | b |", 2, ["Top", "Middle"]), ("TABLE_TEXT", "| c | d |", 2, ["Top", "Middle"]),
        ("UNKNOWN_TEXT", "raw text", 2, ["Top", "Middle"]), ("HEADING", "Other", 1, []), ("PARAGRAPH", "last", 1, ["Other"]),
    ]


def test_chunks_of_sections(spark):
    docs = spark.createDataFrame([(1, MARKDOWN)], "doc_id long, text string")
    b = blocks.markdown_blocks(docs).selectExpr("*", "'t.md' as title")
    rows = chunks.chunk_blocks(b, target=20, most=30, overlap=6).orderBy("ordinal").collect()
    assert [r.source_text for r in rows][0] == "Top\n\nFirst line second line"
    assert rows[0].contextualized_text == "t.md > Top\n\nTop\n\nFirst line second line"
    assert [list(r.section_path) for r in rows][:2] == [["Top"], ["Top", "Middle"]]


def test_cut_covers_and_overlaps():
    text = " ".join(f"w{i}" for i in range(100))
    parts = chunks.cut(text, 30, 6)
    assert parts[0][0] == 0 and parts[-1][1] == len(text) and all(p[2] <= 30 for p in parts)
    assert all(b[0] < a[1] for a, b in zip(parts, parts[1:]))


def test_unit_vectors():
    v = represent.unit_vector("a", 1536)
    assert len(v) == 1536 and abs((v**2).sum() - 1) < 1e-9 and (v == represent.unit_vector("a", 1536)).all()


def test_intake_of_bad_bytes(spark):
    rows = [("A.TXT", b"ok\r\nyes"), ("b.md", b"\xff\xfe x"), ("c.exe", b"x"), ("d.txt", b"  ")]
    out = {r.path: r for r in intake.intake(spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")).collect()}
    assert [out[p].reject for p, _ in rows] == [None, None, "unsupported_media_type", "empty"]


def test_blank_files_and_pages(spark):
    rows = [("a.txt", b" \n\t\r\n"), ("b.txt", b"\x0c x"), ("c.txt", b"")]
    out = {r.path: r.reject for r in intake.intake(spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")).collect()}
    assert out == {"a.txt": "empty", "b.txt": None, "c.txt": "empty"}
    pages = spark.createDataFrame([(1, 0, " \t"), (1, 1, ""), (2, 0, "x"), (2, 1, "\t"), (3, 0, "x")], "doc_id long, page int, line string")
    assert {r.doc_id: (r.n_empty, r.error, r.warning) for r in intake.page_report(pages).collect()} == {1: (2, "scanned_or_image_only", None), 2: (1, None, "empty_pages"), 3: (0, None, None)}


def test_web_text(spark):
    html = "<html><style>p {}</style><script type='x'>var a = '<b>';</script><p>Fish &amp; <b>chips</b>&nbsp;&lt;3</p>\n</html>"
    assert spark.createDataFrame([(html,)], "html string").select(intake.web_text(F.col("html"))).first()[0] == "Fish & chips <3"


def test_chunks_keep_the_order_of_many_blocks(spark):
    docs = spark.createDataFrame([(1, "\n\n".join(f"line {i}." for i in range(10_003)))], "doc_id long, text string")
    b = blocks.text_blocks(docs).selectExpr("doc_id", "'t' as title", "block_id", "type", "text", "array() as section_path").withColumn("section_path", F.array().cast("array<string>"))
    text = "\n\n".join(r.source_text for r in chunks.chunk_blocks(b).orderBy("ordinal").collect())
    assert text.split("\n\n") == [f"line {i}." for i in range(10_003)]


def test_tokenizers_cover_the_text():
    text = "Größe, 漢字 and 🙂 numbers 12345!" * 3
    for name in ("words", "byte_bpe_50k"):
        parts = chunks.cut(text, 10, 3, name)
        assert parts[0][0] == 0 and parts[-1][1] == len(text) and all(p[2] <= 10 for p in parts) and all(b[0] <= a[1] for a, b in zip(parts, parts[1:]))
    assert chunks.tokenizer("byte_bpe_50k")("hello world") == [(0, 5), (5, 11)]


def test_tables_repeat_their_header(spark):
    rows = spark.createDataFrame([(1, 0, i, t) for i, t in enumerate(["h", "a", "b", "c"])] + [(1, 1, 9, "alone")], "doc_id long, table_id long, at int, text string")
    out = {(r.table_id, r.piece): r.text for r in chunks.split_tables(rows, 2).collect()}
    assert out == {(0, 0): "h\na\nb", (0, 1): "h\nc", (1, 0): "alone"}


def test_derived_intents(spark):
    asked = spark.createDataFrame([(1, "Who ruled in March 1944?"), (2, "no date"), (3, "from 27 BCE until 14 CE, and in 1950")], "query_id long, text string")
    assert requests.derive_intents(asked).count() == 0
    out = {r.query_id: (r.relation, r.q_low, r.q_high) for r in requests.derive_intents(asked, enabled=True).collect()}
    assert out == {1: ("POINT", *routes.asked_bounds(1944, 3)), 3: ("RANGE", routes.asked_bounds(-27)[0], routes.asked_bounds(14)[1])}


def test_publication_checks_see_a_wrong_owner(spark):
    tables, _ = small_engine(spark)
    c = tables["chunks"].withColumns({"span_start": F.lit(0), "span_end": F.length("source_text"), "ordinal": F.expr("case chunk_id when 'c2' then 0 when 'c3' then 1 when 'c5' then 2 when 'c4' then 0 else ordinal end")})
    c = c.withColumn("corpus_id", F.expr("if(chunk_id = 'c4', 'elsewhere', corpus_id)")).withColumn("source_text", F.expr("if(chunk_id = 'c0', ' \t\n', source_text)"))
    v = tables["versions"].join(tables["documents"].selectExpr("document_id", "corpus_id", "active_version_id as version_id"), "version_id")
    none = spark.createDataFrame([], "version_id long, start_offset int, end_offset int")
    found = lifecycle.publication_failures(v, c, tables["representations"], none, "srg1", "srg1")
    assert {(r.version_id, r.failure) for r in found.collect()} == {(30, "wrong_lineage"), (10, "empty_lexical"), (10, "span_outside")}


def test_streams(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.select("event_id", "ts", "user_id", "event_type").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string").parquet(str(tmp_path / "in"))
    out = runs.drain(spark, runs.throughput(stream), "throughput", str(tmp_path / "c1"), "complete")
    assert out.exceptAll(runs.throughput(events)).isEmpty() and out.count() == runs.throughput(events).count()
    counts = runs.drain(spark, runs.running_counts(stream), "running", str(tmp_path / "c2"))
    assert counts.agg({"n": "sum"}).first()[0] == events.count()


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_offsets_are_made_for_what_is_cut_only(monkeypatch):
    import tiktoken

    plain, asked = tiktoken.Encoding.decode_with_offsets, []
    monkeypatch.setattr(tiktoken.Encoding, "decode_with_offsets", lambda self, tokens: asked.append(len(tokens)) or plain(self, tokens))
    assert chunks.cut("hello world", 10, 3, "byte_bpe_50k") == [(0, 11, 2)] and not asked
    assert len(chunks.cut("hello world " * 10, 10, 3, "byte_bpe_50k")) > 1 and len(asked) == 1
