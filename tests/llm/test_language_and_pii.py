"""Language identification on held-out texts, and personal data against plain patterns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylag.llm import language, pii
from skylag.llm.queries import QUERIES

# -- language ---------------------------------------------------------------


def test_held_out_texts_are_told_apart(spark, sf_dir):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op3_language"](spark, sf_dir).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95


def test_predictions_do_not_look_at_held_out_labels(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lied = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    a, b = language.fit(docs), language.fit(lied)
    assert a.languages == b.languages and np.array_equal(a.weights, b.weights) and np.array_equal(a.idf, b.idf)


def test_odd_rows(spark):
    rows = [(i, ("the cat and the hat " if i % 2 else "le chat et la souris ") * 3, "en" if i % 2 else "fr") for i in range(80)]
    odd = [(100, None, "en"), (101, "", "fr"), (102, "123 !!", "en"), (103, "the hat " * 100_000, None), (None, "la souris", "fr"), (104, "le chat", None)]
    df = spark.createDataFrame([(*r, "old") for r in [*rows, *odd, *rows[:3]]], "doc_id long, text string, lang string, score string")
    model = language.fit(df)
    got = language.predict(df, model).collect()
    assert len(got) == len(rows) + len(odd) + 3
    told = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert told[100] == told[101] == told[102] == ("und", 0.0)
    assert (told[103][0], told[104][0], told[None][0]) == ("en", "fr", "fr")
    assert language.predict(df.limit(0), model).count() == 0
    assert language.fit(df.limit(0)) is None
    assert language.fit(df.filter("doc_id in (100, 101, 102)")) is None
    assert {(r.lang_pred, r.score) for r in language.predict(df, None).collect()} == {("und", 0.0)}


def test_one_language_and_a_small_sample(spark):
    df = spark.createDataFrame([(i, f"word number {i} of a text", "en") for i in range(200)], "doc_id long, text string, lang string")
    model = language.fit(df, sample_docs=20)
    assert {r.lang_pred for r in language.predict(df, model).collect()} == {"en"}


def test_long_texts_count_every_gram(monkeypatch):
    text = "Some words, and 12 more; été " * 40
    whole = language.gram_counts(text)
    monkeypatch.setattr(language, "CHUNK", 97)
    parts = language.gram_counts(text)
    # A chunk that begins inside a blank run may begin with one blank less.
    assert abs(int(whole.sum()) - int(parts.sum())) <= 3 * (len(text) // 97 + 1)
    assert np.abs(whole - parts).sum() <= 6 * (len(text) // 97 + 1)


def test_training_is_follow_the_regularised_leader(monkeypatch):
    """One weight at a time, as the method is written down."""
    monkeypatch.setattr(language, "BUCKETS", 12)
    monkeypatch.setattr(language, "L1", 0.6)
    draw = np.random.default_rng(6)
    rows = [(draw.choice(12, 4, replace=False), draw.random(4), int(draw.integers(0, 3))) for _ in range(60)]
    z, n = {}, {}

    def weight(i, c):
        gathered = z.get((i, c), 0.0)
        if abs(gathered) <= language.L1:
            return 0.0
        return -(gathered - np.copysign(language.L1, gathered)) / ((language.BETA + np.sqrt(n.get((i, c), 0.0))) / language.ALPHA + language.L2)

    for _ in range(2):
        for at, values, label in rows:
            inputs = [*zip(at.tolist(), values.tolist()), (12, 1.0)]
            now = {(i, c): weight(i, c) for i, _ in inputs for c in range(3)}
            raised = [np.exp(sum(v * now[i, c] for i, v in inputs)) for c in range(3)]
            for c in range(3):
                wrong = raised[c] / sum(raised) - (c == label)
                for i, v in inputs:
                    slope, before = v * wrong, n.get((i, c), 0.0)
                    z[i, c] = z.get((i, c), 0.0) + slope - (np.sqrt(before + slope**2) - np.sqrt(before)) / language.ALPHA * now[i, c]
                    n[i, c] = before + slope**2
    got = language.follow_the_leader(rows, 3, epochs=2)
    assert got == pytest.approx(np.array([[weight(i, c) for c in range(3)] for i in range(13)]))
    assert 0 < np.count_nonzero(got) < got.size


def test_repeated_rows_enter_the_sample_once(spark, monkeypatch):
    trained = []
    inner = language.map_batches
    monkeypatch.setattr(language, "map_batches", lambda df, run, schema: trained.append(df) or inner(df, run, schema))
    rows = [(1, "one and the same english text", "en")] * 3000 + [(i, f"noch ein deutscher satz {i}", "de") for i in range(2, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    assert language.fit(docs, sample_docs=100) is not None
    sample = next(df for df in trained if "order" in df.columns and "text" in df.columns)
    assert sample.filter("language = 'en'").count() <= 1 and 10 < sample.count() < 120


def test_temperature_is_the_likeliest():
    draw = np.random.default_rng(0)
    scores = draw.normal(size=(2000, 3)) * 4
    labels = np.array([draw.choice(3, p=p) for p in language.softmax(scores / 2.0)])
    assert language.calibrated(scores, labels) == pytest.approx(2.0, rel=0.15)
    assert language.calibrated(np.empty((0, 3)), np.empty(0, int)) == 1.0


# -- personal data ----------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PIECES = ["a@b.c", "_d", "@", "e.f", ".", "..", "1.2.3.4", "256", "255.1.1.1", "001.2.3.4", "4111 1111 1111 1111", "4111111111111111", "-", " ", "  ", "+1 (499) 555-6503", "+", "1", "22", "x", "é", "😀", "(at)", "4111-1111-1111-1111", "\n", "%", "0", "378282246310005", "5105105105105100", " (dot) ", "com", "9999999999"]


def passes(kind, match):
    number = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(part) <= 255 for part in match.split("."))
    if kind == "phone":
        return 10 <= len(number) <= 15
    if kind == "card":
        total = sum(int(d) if i % 2 == 0 else int(d) * 2 - 9 * (int(d) > 4) for i, d in enumerate(reversed(number)))
        return 14 <= len(number) <= 19 and total % 10 == 0
    return True


def plain_spans(text):
    found = [(m.start(), rank, kind, m.end()) for rank, (kind, pattern) in enumerate(PATTERNS.items()) for m in re.finditer(pattern, text or "") if passes(kind, m[0])]
    return [f"{kind}:{start}:{end}" for start, _, kind, end in sorted(found)]


@pytest.fixture(scope="module")
def odd_texts():
    draw = random.Random(3)
    odd = ["".join(draw.choice(PIECES) for _ in range(draw.randint(0, 14))) for _ in range(3000)]
    return [*odd, None, "", "a" * 50_000, "1" * 30_000, "1 " * 20_000, "a.b" * 20_000, "+1" + "(" * 30_000, "a@" + "b." * 20_000 + "c", "1.1." * 5_000, odd[0], odd[0]]


def test_base_spans_are_those_of_the_plain_patterns(spark, odd_texts):
    df = spark.createDataFrame(list(enumerate(odd_texts)), "doc_id long, text string").repartition(8)
    model = pii.fit(df)
    found = pii.label(df, model).select("doc_id", pii.span_list(F.col("base")).alias("base"), pii.span_list(F.col("spans")).alias("spans"))
    for r in found.collect():
        want = plain_spans(odd_texts[r.doc_id])
        assert r.base == ",".join(want), odd_texts[r.doc_id][:200]
        assert set(want) <= set(r.spans.split(",")) | {""}


def test_pii_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op1_pii"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in pii.KINDS]


def test_labelers_teach_the_classifier(spark):
    """Phones without a plus are accepted where phones in general are reliable; bare numbers are not."""
    texts = []
    for i in range(300):
        texts += [f"call +1 (4{i % 90 + 10}) 555-0{i % 900 + 100} now", f"phone: (4{i % 90 + 10}) 555-{i + 1000} or later", f"order no 7{i + 100000} was sent", f"version 3{i + 1000000}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = pii.fit(df)
    assert model.reliability["phone"]["context"][1][0] > model.reliability["phone"]["context"][1][1]
    assert model.reliability["phone"]["warning"][-1][1] > model.reliability["phone"]["warning"][-1][0]
    got = {r.doc_id: r.s for r in pii.label(df, model, accepted=0.5).select("doc_id", F.size("spans").alias("s")).collect()}
    assert all(got[i] == 1 for i in range(len(texts)) if i % 4 < 2)
    assert all(got[i] == 0 for i in range(len(texts)) if i % 4 >= 2)


def planted(draw):
    """(text, spans of personal data beyond the base patterns) in four languages, with look-alikes."""
    word = lambda: "".join(draw.choices("etaoinshrdlu", k=draw.randint(3, 9)))
    digits = lambda n: "".join(draw.choices("0123456789", k=n))
    hexes = lambda n: "".join(draw.choices("0123456789abcdef", k=n))
    mixed = lambda n: "aZ9" + "".join(draw.choices("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789", k=n))
    found = {
        "secret": [("token = \"", hexes(40), "\""), ("api key: ", mixed(29), ""), ("password = '", mixed(20), "'"), ("Authorization: Bearer ", mixed(40), "")],
        "email": [("mail ", f"{word()}.{word()} (at) {word()} (dot) org", ""), ("Kontakt: ", f"{word()}(at){word()}.de", "")],
        "name": [("my name is ", f"{draw.choice(['Mary', 'John'])} {word().title()}", ""), ("gezeichnet ", f"Herr {draw.choice(['Klaus', 'Stefan'])} {word().title()}", ""), ("firmado por ", f"Señora {draw.choice(['Carmen', 'Pilar'])} {word().title()}", ""), ("signé par ", f"Madame {draw.choice(['Camille', 'Sylvie'])} {word().title()}", "")],
    }
    decoys = [f"commit {hexes(40)}", f"sha256 {hexes(64)}", f"order no {digits(9)}", f"version {digits(8)}", f"{word()}-{word()}-{word()}-{word()}", f"{word().title()} {word().title()}", "-" * 30, f"{word()}/{word()}/{word()}/{word()}"]
    text, spans = word() + " ", []
    for kind in draw.sample(sorted(found), draw.randint(0, 3)):
        before, hit, after = draw.choice(found[kind])
        text += before
        spans.append(f"{kind}:{len(text)}:{len(text) + len(hit)}")
        text += f"{hit}{after} {word()} "
    for decoy in draw.sample(decoys, 2):
        text += f"{decoy}, {word()} "
    return text, spans


def test_planted_examples_are_found_at_the_default_threshold(spark):
    draw = random.Random(12)
    rows = [planted(draw) for _ in range(1200)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    found = pii.label(df, pii.fit(df)).select("doc_id", pii.span_list(F.col("spans")).alias("s")).collect()
    got = {(r.doc_id, s) for r in found for s in r.s.split(",") if s}
    want = {(i, s) for i, (_, spans) in enumerate(rows) for s in spans}
    assert len(got & want) > 0.97 * len(got), [rows[i][0][int(s.split(":")[1]) - 12 : int(s.split(":")[2])] for i, s in sorted(got - want)[:5]]
    for kind in ("secret", "email", "name"):
        own = {x for x in want if x[1].startswith(kind)}
        assert len(got & own) > 0.9 * len(own), (kind, [rows[i][0][int(s.split(":")[1]) - 12 : int(s.split(":")[2])] for i, s in sorted(own - got)[:5]])


def test_tokens_of_the_documents_are_secrets(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r.spans.split(",") for r in QUERIES["op1_pii"](spark, sf_dir).collect()}
    want = {(i, f"secret:{m.start(1)}:{m.end(1)}") for i, t in texts.items() for m in re.finditer('token = "([0-9a-f]{40})"', t)}
    assert {(i, s) for i in got for s in got[i] if s.startswith("secret")} == want


def test_pii_without_candidates_and_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "nothing here", "x", 1), (None, None, None, None)], "doc_id long, text string, base string, spans int")
    assert pii.fit(df) is None and pii.fit(df.limit(0)) is None
    assert [(len(r.base), len(r.spans)) for r in pii.label(df, None).collect()] == [(0, 0), (0, 0)]
    kept = pii.label(df, None, base="b", spans="s").collect()
    assert [(r.base, r.spans) for r in kept] == [("x", 1), (None, None)]


def test_redaction(spark):
    df = spark.createDataFrame([("é a@b.c, 1.2.3.4 and 4111 1111 1111 1111.",), ("none",), ("",), ("4111111111111111@x.y z",)], "text string")
    spans = F.array_sort(F.concat(*[pii.tagged(s, k) for k, s in pii.base_spans(F.col("text")).items()]))
    got = [r.t for r in df.select(pii.redacted(F.col("text"), spans).alias("t")).collect()]
    assert got == ["é <EMAIL>, <IP> and <CARD>.", "none", "", "<EMAIL> z"]
