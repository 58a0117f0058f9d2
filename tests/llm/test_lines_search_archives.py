"""Line templates, exact top-k and archives."""

import base64
import hashlib
import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skylag.llm import bit_sliced, line_templates, warc_zip
from skylag.llm.bitmap import bitmap, maybe_member
from skylag.llm.queries import ORACLES, QUERIES
from skylag.session import scratch_path


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(want, key=str)


# -- lines ------------------------------------------------------------------


def drop(spark, rows, **options):
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, lines_dropped string")
    return line_templates.drop_recurring(df, **options)


def test_variable_fields_are_generalised(spark):
    rows = [(i, f"own text number {'x' * i}\nUser login from host {name} took {i} ms total") for i, name in enumerate(["alpha", "beta", "gamma", "delta"])]
    got = {r.doc_id: r.text for r in drop(spark, rows, depth=2).collect()}
    assert got[0] == rows[0][1]
    assert all(got[i] == f"own text number {'x' * i}" for i in (1, 2, 3))


def test_lines_that_stay(spark):
    same = "All of this line comes back again"
    rows = [
        (1, f"first here\n{same}"), (2, f"{same}\n{same}"), (3, f"  {same}  \nlast"), (3, f"  {same}  \nlast"), (4, None), (5, ""), (None, same), (6, "All rights reserved."),
        (7, "All rights reserved."), (8, "All rights reserved."), (9, "twice only in two documents"), (10, "twice only in two documents"), (3, "another text of three"),
    ]
    got = sorted(((r.doc_id, r.text, r.lines_dropped) for r in drop(spark, rows).collect()), key=str)
    want = [
        (1, f"first here\n{same}", 0), (2, "", 2), (3, "last", 1), (3, "last", 1), (4, None, 0), (5, "", 0), (None, same, 0), (6, "All rights reserved.", 0), (7, "", 1),
        (8, "", 1), (9, "twice only in two documents", 0), (10, "twice only in two documents", 0), (3, "another text of three", 0),
    ]
    assert got == sorted(want, key=str)
    assert drop(spark, rows).limit(0).count() == 0
    assert line_templates.drop_recurring(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_lines_recur_from_two_documents_on(spark):
    words = [f"w{chr(97 + i % 26)}{'x' * (i // 26)}" for i in range(60)]
    other = [w if i % 7 else w + "q" for i, w in enumerate(words)]
    rows = [(1, "own first\n" + " ".join(words)), (2, " ".join(words) + "\nown second"), (3, "own\nthird"), (4, " ".join(other[:51]) + "\nfourth")]
    got = {r.doc_id: (r.text, r.lines_dropped) for r in drop(spark, rows).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("own second", 1), 3: (rows[2][1], 0), 4: (rows[3][1], 0)}
    # Lines of one shape in two documents, some words apart.
    rows = [(1, " ".join(words)), (2, " ".join(w if i % 9 != 5 else "own" for i, w in enumerate(words)))]
    assert {r.doc_id: r.lines_dropped for r in drop(spark, rows).collect()} == {1: 0, 2: 1}


def test_many_lines_of_one_document(spark):
    """Dropped lines at the ends of words of the bitmap, and long runs of kept ones between them."""
    gone = {0, 1, 62, 63, 64, 127, 128, 5000, 9999}
    same = "this line stands in three documents"
    rows = [(k, "\n".join(same if i in gone else f"{'q' * k} z{'x' * (i % 97)} {chr(97 + i % 26)} own" if i % 2 else "" for i in range(10_000))) for k in (1, 2, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in line_templates.drop_recurring(df, depth=1, constant_share=2.0).collect()}
    assert got[1].lines_dropped == 0
    for k in (2, 3):
        assert got[k].text == "\n".join(line for i, line in enumerate(rows[k - 1][1].split("\n")) if i not in gone)
        assert got[k].lines_dropped == len(gone)


def test_columns_called_like_helpers_pass_through(spark):
    same = "All of this line comes back again"
    df = spark.createDataFrame([(k, same, "v", k, [1]) for k in (1, 2, 3)], "doc_id long, text string, _version string, _maybe long, words array<int>")
    got = line_templates.drop_recurring(df)
    assert got.columns == [*df.columns, "lines_dropped"]
    assert sorted(map(tuple, got.collect())) == [(1, same, "v", 1, [1], 0), (2, "", "v", 2, [1], 1), (3, "", "v", 3, [1], 1)]


def test_bitmap_never_rules_out_a_member(spark):
    members = spark.range(0, 3000, 3).select(F.xxhash64("id").alias("h"))
    rows = spark.range(3000).select("id", F.xxhash64("id").alias("h"))
    told = {r.id: r.maybe for r in maybe_member(rows, F.col("h"), bitmap(members, "h")).collect()}
    assert all(told[i] for i in range(0, 3000, 3))
    assert sum(told.values()) < 1100
    assert not any(r.maybe for r in maybe_member(rows, F.col("h"), bitmap(members.limit(0), "h")).collect())


# -- top-k ------------------------------------------------------------------


def plain_top(rows, asked, k):
    good = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all()]
    queries = {(i, tuple(v)) for i, v in good if asked(i)}
    found = []
    for i, q in queries:
        scores = sorted((-int(np.dot(q, v)), j) for j, v in good if j != i and len(v) == len(q))
        found += [(i, rank, j, -s) for rank, (s, j) in enumerate(scores[:k], 1)]
    return sorted(found)


@pytest.mark.parametrize("rows_per_block", [16, 100, 32768])
def test_top_k_is_exact(spark, rows_per_block):
    draw = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in draw.normal(size=9) * 0.4]) for i in range(230)]
    rows += [(300 + i, rows[7][1]) for i in range(12)] + [(7, rows[8][1]), (8, rows[8][1]), (8, rows[8][1])]  # ties and repeated ids
    rows += [(400, None), (401, []), (402, [float("nan")] * 9), (403, [None] * 9), (404, [float("inf")] * 9), (None, rows[0][1]), (410, [0.5, 0.25]), (420, [0.5, 0.75]), (430, [0.0] * 9), (440, [1e3] * 9)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(5)
    got = bit_sliced.top_k(df, F.col("vec_id") % 10 == 0, 5, rows_per_block=rows_per_block, queries_per_block=7)
    want = plain_top([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], lambda i: i % 10 == 0, 5)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == want
    assert dict(got.dtypes)["rank"] == "int"


def test_top_k_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in bit_sliced.top_k(df, F.col("vec_id") == 0, 5).collect()] == [(0, 1, 1)]
    assert bit_sliced.top_k(df, F.col("vec_id") == 9, 5).count() == 0
    assert bit_sliced.top_k(df.limit(0), F.col("vec_id") == 0, 5).count() == 0


def test_slices_hold_the_rows():
    draw = np.random.default_rng(5)
    values = draw.integers(-300, 300, (150, 6))
    block = bit_sliced.Block.of(np.arange(150), values)
    assert np.array_equal(block.rows(np.arange(150)), values)
    query = draw.integers(-9, 9, 6)
    sums = bit_sliced.added(block.slices, query)
    bits = [np.unpackbits(s.view(np.uint8), bitorder="little")[:150].astype(int) for s in sums]
    total = sum(b << i for i, b in enumerate(bits))
    rest = (values - values.min(axis=0)).astype(int)
    full = (1 << block.slices.shape[1]) - 1
    assert np.array_equal(total, np.where(query < 0, full - rest, rest) @ np.abs(query))


# -- archives ---------------------------------------------------------------


def archived(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, key string").repartition(3)
    packages = warc_zip.write(df, scratch_path(spark, "warc"), **options)
    return packages, warc_zip.read(packages, range_bytes=200)


def test_records_come_back(spark):
    rows = [(5, "http://a/b c", "<p>é</p>"), (2, None, "same"), (9, "u\r\nInjected: 1", "same"), (3, "u", "same"), (4, "", None), (6, "u", ""), (7, "u", "x" * 400_000), (None, "u", "same"), (2, "u", "same"), (8, "u", "a\r\n\r\nb")]
    packages, found = archived(spark, rows, package_bytes=600)
    got = sorted(((r.key, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to) for r in found.collect()), key=str)
    first = {"same": 2, "": 4}
    want = []
    for key, _, html in rows:
        raw = (html or "").encode()
        origin = first.get(html or "")
        revisit = key is not None and origin is not None and key > origin
        want.append((key, "revisit" if revisit else "response", len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), origin if revisit else None))
    assert got == sorted(want, key=str)
    payloads = {r.key: bytes(r.payload) for r in found.filter("record_type = 'response' AND key IS NOT NULL").collect()}
    assert payloads[7] == b"x" * 400_000 and payloads[8] == b"a\r\n\r\nb"
    assert packages.count() > 3 and packages.agg(F.sum("records")).first()[0] == len(rows)
    with zipfile.ZipFile(packages.first().path) as package:  # any other reader can open it
        assert {warc_zip.ARCHIVE, warc_zip.INDEX} <= set(package.namelist()) and package.testzip() is None


def test_warc_query_is_brute_force(spark, sf_dir):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    first = {}
    for k in sorted(pages):
        first.setdefault(pages[k], k)
    digest = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    want = sorted((k, len(b), digest(b), "response" if first[b] == k else "revisit", None if first[b] == k else first[b]) for k, b in pages.items())
    got = QUERIES["op10_warc"](spark, sf_dir).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got)) == want


def test_small_payloads_can_stay_responses(spark):
    _, found = archived(spark, [(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcdef"), (4, "u", "abcdef")], least_bytes=5)
    assert {r.key: r.refers_to for r in found.collect()} == {1: None, 2: None, 3: None, 4: 3}


def test_no_pages(spark):
    packages, found = archived(spark, [(1, "u", "x")])
    none = warc_zip.write(spark.createDataFrame([], "page_id long, url string, html string"), scratch_path(spark, "warc"))
    assert none.count() == 0 and warc_zip.read(none).count() == 0 and found.count() == 1


def test_zip64_directory_is_read():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as package:
        for i in range(65_600):  # more entries than the plain end record can count
            package.writestr(f"m{i}", b"%d" % i if i % 9000 == 0 else b"")
        package.comment = b"a comment after the end record"
    raw = out.getvalue()
    read = lambda start, length: raw[start : start + length]
    members = warc_zip.central_directory(read, len(raw))
    assert len(members) == 65_600
    for name, method, size, offset in members[::9000]:
        start = warc_zip.data_start(read, offset)
        assert method == 0 and raw[start : start + size] == name[1:].encode()
    for broken in (b"", b"not a package" * 10):
        with pytest.raises(ValueError):
            warc_zip.central_directory(lambda s, n, b=broken: b[s : s + n], len(broken))


def test_compressed_members_are_refused(spark, tmp_path):
    path = str(tmp_path / "packed.wacz")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as package:
        package.writestr(warc_zip.ARCHIVE, b"x" * 100)
        package.writestr(warc_zip.INDEX, b"")
    with pytest.raises(Exception, match="cannot be read by range"):
        warc_zip.read(spark.createDataFrame([(path,)], "path string")).count()


def test_damaged_payloads_are_found():
    member = warc_zip.record(1, "u", b"payload", None)
    assert warc_zip.parsed(member)["payload"] == b"payload"
    import gzip

    with pytest.raises(ValueError, match="does not match"):
        warc_zip.parsed(gzip.compress(gzip.decompress(member).replace(b"payload\r\n\r\n", b"pay1oad\r\n\r\n")))


def staged(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, df, "").collect()}


def test_pipeline_drops_recurring_lines_of_any_share_and_length(spark):
    one, two = "this line stands in many documents", "and this one stands in many others"
    passage = " ".join(f"word{chr(97 + i % 26)}{'x' * (i // 26)}" for i in range(60))
    brief = "All rights reserved."
    rows = [(1, one), (2, f"{one}\n{two}"), (3, f"{two}\n{one}\nonly here are these words"), (4, f"{one}\n{two}\nquite different closing words here")]
    rows += [(5, f"{passage}\nwith an ending of its own"), (6, f"a start of another kind\n{passage}"), (7, "twice only in two documents"), (8, "twice only in two documents")]
    rows += [(k, f"{'z' * k} begins this one\n\n{brief}\n{k}") for k in (10, 11, 12)]
    got = staged(spark, rows)
    assert (got[1], got[2], got[3], got[4]) == (one, two, "only here are these words", "quite different closing words here")
    assert (got[5], got[6]) == (rows[4][1], "a start of another kind")
    assert got[7] == got[8] == "twice only in two documents"
    assert got[10] == rows[8][1] and all(got[k] == f"{'z' * k} begins this one\n\n{k}" for k in (11, 12))


def test_each_variant_is_read_again_in_its_first_document_only(spark, monkeypatch):
    found, plain = [], line_templates.maybe_member

    def spy(df, *rest):
        told = plain(df, *rest)
        if "line" in df.columns:
            found.append(sorted((r.key, r.line) for r in told.filter("maybe").collect()))
        return told

    monkeypatch.setattr(line_templates, "maybe_member", spy)
    lines = ["one two three four five red seven eight", "one two three four five blue seven eight"]
    docs = spark.createDataFrame([(i, "\n".join(lines if i else lines[:1])) for i in range(40)], "doc_id long, text string")
    line_templates.drop_recurring(docs).count()
    assert found == [[(0, lines[0]), (1, lines[1])]]
