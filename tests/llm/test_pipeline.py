"""The stages one after another, each against plain Python on its own input."""

import os
import re

import pytest

import corpus_pipeline
from lodemill.llm import quality_net

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
def test_stages(spark, tmp_path):
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    seen, docs = [raw], raw
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(docs)
    assert [d.columns for d in seen[1:-1]] == [raw.columns] * 4
    rows = [{r.doc_id: r for r in d.collect()} for d in seen[:-1]]

    # The classifier's kept rows are those that its scores keep, unchanged.
    net = quality_net.fit(raw, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in quality_net.scores(raw, net).collect() if r.predicted}
    assert set(rows[1]) == good and all(rows[1][i] == rows[0][i] for i in good)

    # Lines.
    first = {}
    for i in sorted(rows[1]):
        for line in rows[1][i].text.split("\n"):
            first.setdefault(_lower(line.strip("\t\n\x0b\x0c\r ")), i)
    for i, r in rows[1].items():
        kept = [x for x in r.text.split("\n") if len(key := _lower(x.strip("\t\n\x0b\x0c\r "))) < 10 or first[key] == i]
        assert rows[2][i].text == "\n".join(kept)

    # One of each group of near duplicates.
    sets = {}
    for i, r in rows[2].items():
        w = re.findall("[^\x20\x09-\x0d]+", r.text)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    top = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and (sets[a] == sets[b] or (sets[a] & sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])))]
    for _ in sets:
        for a, b in links:
            top[a] = top[b] = min(top[a], top[b])
    assert set(rows[3]) == set(top.values())

    # Benchmark passages.
    windows = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = WORD.findall(_lower(r.text))
        for k in range(max(1, len(w) - 7) if w else 0):
            windows.setdefault(tuple(w[k : k + 8]), set()).add(r.item_id)
    for i, r in rows[3].items():
        w = WORD.findall(_lower(r.text))
        items = {x for n in {len(k) for k in windows} for k in range(len(w) - n + 1) for x in windows.get(tuple(w[k : k + n]), ())}
        if len(items) >= 2:
            assert i not in rows[4]
        elif not items:
            assert rows[4][i] == r
        else:
            left = WORD.findall(_lower(rows[4][i].text))
            assert len(left) < len(w)

    packed = seen[-1].collect()
    assert {r.doc_id for r in packed} == set(rows[4])
    used = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 2048
    assert corpus_pipeline.run(spark, SF).count() == len(packed)


def _odd(spark, folder):
    """Tables with nulls, empty and repeated rows, shared ids, and names that operators use inside."""
    passage = "Nine plain words stand here as one benchmark passage today"
    other = "Another benchmark item of exactly nine words stands right here"
    prose = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, "a line that is long enough\nown first line here"), (2, "a line that is long enough\nown second line here"), (2, "a line that is long enough\nown second line here"), (None, "no id but a text of its own"),
        (None, "no id and quite another text"), (3, None), (4, ""), (5, f"{prose} {passage} tail"), (6, f"{prose} {passage}. And {other}!"), (7, f"{prose} word60"), (8, f"{prose} word61"), (9, "shared id one, words apart"),
        (9, "shared id two, all of them different"), (10, "\n\n"), (11, prose.upper()),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "CAST(NULL AS STRING) AS source", "CAST(length(text) AS BIGINT) AS n_chars", "1 AS d", "2 AS _id", "3 AS row", "4 AS keep", "5 AS n")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([("x", passage), ("y", other), ("z", None), (None, "")], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet"), passage, prose


def test_stages_on_odd_rows(spark, tmp_path, monkeypatch):
    docs, passage, prose = _odd(spark, tmp_path)
    sf = str(tmp_path)
    key = lambda rows: sorted((str(r.doc_id), str(r.text)) for r in rows)
    good = corpus_pipeline.good_quality(spark, docs, sf)
    scores = quality_net.scores(docs, quality_net.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))).collect()
    assert good.columns == docs.columns and good.count() == sum(r.predicted for r in scores) and set(key(good.collect())) <= set(key(docs.collect()))

    lines = corpus_pipeline.first_lines(spark, docs, sf)
    assert lines.columns == docs.columns
    text = {r.doc_id: r.text for r in lines.collect()}
    assert lines.count() == docs.count() and text[1] == "a line that is long enough\nown first line here" and text[2] == "own second line here"
    assert text[3] is None and text[4] == "" and text[10] == "\n\n"

    one = corpus_pipeline.one_of_each(spark, docs, sf)
    assert one.columns == docs.columns
    left = key(one.collect())
    # The repeated row, texts without words but the first, and near copies go; rows without an id and with one id stay.
    assert left == key([r for r in docs.distinct().collect() if r.doc_id not in (4, 10, 6, 7, 8)]) and len(left) == 9

    clean = corpus_pipeline.no_benchmark(spark, docs, sf)
    assert clean.columns == docs.columns
    want = [r for r in key(docs.collect()) if r[0] not in ("5", "6")] + [("5", f"{prose}  tail")]
    assert key(clean.collect()) == sorted(want)

    packed = corpus_pipeline.packed_sequences(spark, docs, sf).collect()
    assert sorted(str(r.doc_id) for r in packed) == sorted(str(r.doc_id) for r in docs.collect())
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0
    monkeypatch.setattr(corpus_pipeline.quality_net, "keep_good", lambda rows, labels: rows)
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} >= {None, 1, 3, 5, 9, 11}
