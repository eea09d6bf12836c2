"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns with clashing names."""

import pytest

from probatio.llm import chat, decontamination, language, licenses, mixing, near_duplicates, ppm, quality, toxicity, warc

EXTRA = "language string, ledger string, hits string, row long, __place string, __ledger string, __hits string, __language string, key string, k string, block int, bucket int, src string, h long, size long, hit string, role_ string, component string, label string"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
LONG = "one two three four five six seven eight nine ten " * 4000
TEXTS = [None, "", " \n\t", "word", "a b c d e f g h i j k l m n o p q r s t u v w x y z", "a b c d e f g h i j k l m n o p q r s t u v w x y z", LONG, "été 漢字 😀 \x00 x", "#" * 500]


def docs(spark, rows=True):
    extra = ("x", "x", "x", 1, "x", "x", "x", "x", "x", "x", 1, 1, "x", 1, 1, "x", "x", "x", "x")
    made = [(i, t, ["en", None, "fr"][i % 3], ["s", None][i % 2], None, *extra) for i, t in enumerate(TEXTS)] if rows else []
    made += [made[4], (None, None, None, None, None, *extra), (None, "a null id", "en", "s", 1, *extra)] if rows else []
    return spark.createDataFrame(made, DOCS)


def items(spark, rows=True):
    made = [(1, "m n o p q r s t u v w x"), (2, None), (3, ""), (1, "m n o p q r s t u v w x"), (None, "seven eight nine ten one two three")]
    return spark.createDataFrame([(*m, "x", "x") for m in made] if rows else [], "item_id long, text string, doc_id string, hit string")


def labels(spark, rows=True):
    made = [(0, 1, 0), (1, None, None), (None, 1, 1), (3, 0, 1), (3, 0, 0), (6, 1, 0)]
    return spark.createDataFrame([(*m, "x", 0.5) for m in made] if rows else [], "doc_id long, quality int, toxic int, text string, score double")


BY_ROW = {
    "quality": lambda s, r: quality.apply_policy(quality.ledger(docs(s, r))),
    "near": lambda s, r: near_duplicates.near_duplicates(docs(s, r)),
    "ppm": lambda s, r: ppm.score_documents(docs(s, r)),
    "language": lambda s, r: language.identify(docs(s, r)),
    "toxicity": lambda s, r: toxicity.score(docs(s, r), labels(s, r)),
    "mixing": lambda s, r: mixing.mix(docs(s, r)),
    "licenses": lambda s, r: licenses.scan(docs(s, r)),
}


@pytest.mark.parametrize("name", sorted(BY_ROW))
def test_one_row_for_each_row(name, spark):
    rows = BY_ROW[name](spark, True).collect()
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows)
    assert ids == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in docs(spark).collect())


@pytest.mark.parametrize("name", sorted(BY_ROW))
def test_empty_tables(name, spark):
    assert BY_ROW[name](spark, False).collect() == []


def test_labels_without_rows(spark):
    assert toxicity.score(docs(spark), labels(spark, False)).count() == docs(spark).count()


def test_near_duplicates_of_odd_texts(spark):
    rows = {(r["doc_id"], r["n_links"]): r["class_id"] for r in near_duplicates.near_duplicates(docs(spark)).collect()}
    assert rows[(4, 2)] == 4 and rows[(5, 2)] == 4
    assert all(rows[(i, 0)] == i for i in (0, 1, 2, 3, 6, 7, 8))
    kept = near_duplicates.keep_first(docs(spark))
    assert kept.columns == docs(spark).columns
    assert kept.count() == len(TEXTS) + 1  # of three copies one stays, the texts without words all


def test_decontamination_of_odd_tables(spark):
    found = decontamination.contaminations(docs(spark), items(spark)).select("doc_id", "item_id").collect()
    assert sorted((r[0], r[1] or 0) for r in found) == sorted([(4, 1)] * 4 + [(5, 1)] * 2 + [(6, 0)])
    assert decontamination.contaminations(docs(spark, False), items(spark)).collect() == []
    assert decontamination.contaminations(docs(spark), items(spark, False)).collect() == []
    left = decontamination.clean(docs(spark), items(spark))
    assert left.columns == docs(spark).columns
    assert left.where("doc_id IN (4, 5, 6)").count() == 0 and left.count() == docs(spark).count() - 4


def test_pages(spark):
    schema = "page_id long, url string, html string, member string, digest string"
    pages = [(1, "u", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", "x" * 300_000), (6, "u", "é")]
    rows = warc.read_bundles(warc.write_bundles(spark.createDataFrame([(*p, "x", "x") for p in pages], schema)))
    found = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in rows.collect()}
    assert found == {1: (4, "response", None), 2: (4, "revisit", 1), 3: (0, "response", None), 4: (0, "revisit", 3), 5: (300_000, "response", None), 6: (2, "response", None)}
    assert warc.read_bundles(warc.write_bundles(spark.createDataFrame([], schema))).collect() == []


def test_conversations(spark):
    schema = "conv_id long, turn long, role string, text string, key string, n_turns long"
    turns = [(1, 0, "user", "<s> [INST] &amp; \\"), (1, 1, "assistant", None), (2, 0, "assistant", "</s>[/INST]"), (3, 0, "user", ""), (None, 0, "assistant", "null id")]
    rows = chat.digests(chat.format_chats(chat.with_probe(spark.createDataFrame([(*t, "x", 1) for t in turns], schema)))).collect()
    found = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in rows}
    assert found[1] == (2, 0) and found[2] == (1, 11) and found[3] == (1, 0) and found[-1] == (2, 21)
    assert -1 in {r["conv_id"] for r in chat.digests(chat.format_chats(chat.with_probe(spark.createDataFrame([], schema)))).collect()}


BIG = (1 << 53) + 1


def test_big_ids_beside_null_ones(spark):
    """Ids beyond 2^53 stay exact where other ids of the batch are null."""
    pages = spark.createDataFrame([(BIG, "u", "same"), (BIG + 2, "u", "same"), (None, "u", "same"), (None, "u", "other")], "page_id long, url string, html string").coalesce(1)
    rows = [(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read_bundles(warc.write_bundles(pages)).collect()]
    assert sorted(rows, key=str) == sorted([(BIG, "response", None), (BIG + 2, "revisit", BIG), (None, "revisit", BIG), (None, "response", None)], key=str)
    texts = spark.createDataFrame([(BIG, "a text"), (None, "no id"), (BIG + 2, "another")], "doc_id long, text string").coalesce(1)
    assert {r["doc_id"] for r in ppm.score_documents(texts).collect()} == {BIG, BIG + 2, None}


def test_archives_are_read_by_record(spark, tmp_path):
    """Repeated and null page ids, the seek table, and records by identifier from an exported archive alone."""
    pages = [(7, "u", "first"), (7, "u", "second"), (None, None, "third"), (8, "u", "x" * 600_000), (9, "u", "first")]
    bundles = warc.write_bundles(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1))
    archives = [(tmp_path / name).read_bytes() for name in warc.export(bundles, str(tmp_path))]
    held = {name: content for content in archives for name in warc.read_index(content)}
    assert set(held) == {"<urn:x-page:7>", "<urn:x-page:8>", "<urn:x-page:9>", "<urn:x-page:null>"}
    frames = [frame for content in archives for frame in warc.seek_table(content)]
    assert len(frames) >= 2 and sum(size for _, _, size in frames) > 600_000
    headers, block = warc.read_one(held["<urn:x-page:8>"], "<urn:x-page:8>")
    assert headers["WARC-Type"] == "response" and block.endswith(b"x" * 600_000)
    headers, block = warc.read_one(held["<urn:x-page:9>"], "<urn:x-page:9>")
    assert headers["WARC-Type"] == "revisit" and headers["WARC-Refers-To"] == "<urn:x-page:7>" and block.endswith(b"\r\n\r\n")
    assert warc.read_bundles(bundles).count() == len(pages)


def test_turns_that_tie_or_lack_a_conversation(spark):
    turns = [(1, 0, None, "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "assistant", "x"), (None, 0, "assistant", "p"), (None, 0, "assistant", "p"), (None, 1, "user", "q"), (2, 0, "user", "y" * 100_000), *((2, i, "assistant", "z") for i in range(1, 60))]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rows = chat.digests(chat.format_chats(table)).collect()
    assert sorted((r["conv_id"] or 0, r["n_turns"], r["loss_chars"]) for r in rows) == [(0, 1, 0), (0, 1, 1), (0, 1, 1), (1, 4, 1), (2, 60, 59)]
    text = chat.format_chats(table.where("conv_id = 1")).where("is_last").first()["formatted"]
    assert text == "<s>[INST]assistant[/INST]x</s><s>[INST][/INST]b</s><s>[INST]user[/INST]a</s><s>[INST]user[/INST]a</s>"


def test_target_just_under_a_whole_repetition(spark):
    """Weights that leave a source half a word under its size: it is taken whole, not left out."""
    words = lambda n: " ".join(["w"] * n)
    docs = spark.createDataFrame([(1, words(1000), "a"), (2, words(1001), "b"), (None, "x", "a"), (None, "y", "a"), (3, None, None)], "doc_id long, text string, source string")
    rows = mixing.mix(docs, weights=(1, 1, 1)).collect()
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert abs(sum(r["taken"] for r in rows) - 2003) <= 1
    assert by[1]["target"] == by[2]["target"] == 1001.5 and by[2]["taken"] in (1001, 1002)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(3), weights=(1, 1, 1)).collect()))


def test_many_sources(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('w ', int(id % 7) + 1) AS text", "concat('site', id) AS source")
    rows = mixing.mix(docs).collect()
    assert len(rows) == 3000 and all(r["taken"] <= 3 * r["size"] for r in rows)
    assert abs(sum(r["target"] for r in rows) - sum(r["size"] for r in rows)) < 1e-6 * len(rows)


def test_checkpoints_need_a_shared_folder_only_on_a_cluster(spark):
    from probatio.llm import common

    assert common.checkpoint_folder(spark)


@pytest.mark.parametrize("rows", [True, False])
def test_stages_on_odd_tables(spark, rows, tmp_path):
    """Nulls, empty tables, repeated rows and clashing names through every stage of the pipeline."""
    import corpus_pipeline

    items(spark, rows).write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs(spark, rows), str(tmp_path))
        assert after.columns == docs(spark, rows).columns and after.count() <= docs(spark, rows).count(), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs(spark, rows), str(tmp_path)).count() == docs(spark, rows).count()


def test_whole_licences(spark):
    """A licence is found whatever its case, punctuation, copyright line and spelling, and only whole."""
    mit = licenses._MIT
    changed = "Copyright (c) 2020 Somebody\n\n" + mit.upper().replace("LICENSE", "LICENCE").replace(",", " ,").replace("\n\n", "\n")
    tables = [(1, mit), (2, "MIT License\n\nCopyright 2011 me\n\n" + mit), (3, changed), (4, mit[:-20]), (5, mit + " more"), (6, "Licensed under the MIT licence."), (7, licenses._ZLIB.replace("acknowledgment", "acknowledgement"))]
    found = {r["doc_id"]: (r["license_id"], r["notices"]) for r in licenses.scan(spark.createDataFrame(tables, "doc_id long, text string")).collect()}
    assert [found[i][0] for i in range(1, 8)] == ["MIT", "MIT", "MIT", None, None, "MIT", "Zlib"] and found[6] == ("MIT", "MIT")
    folder = "/usr/share/common-licenses"
    shelf = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    import os

    whole = [(n, open(f"{folder}/{name}", encoding="utf-8").read()) for n, name in enumerate(shelf) if os.path.exists(f"{folder}/{name}")]
    if whole:
        found = {r["doc_id"]: r["license_id"] for r in licenses.scan(spark.createDataFrame(whole, "doc_id long, text string")).collect()}
        assert all(found[n] == list(shelf.values())[n] for n, _ in whole)
