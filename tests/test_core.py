import hashlib
import shutil
from pathlib import Path

import pytest
from compare import differ, views
from pyspark.sql import functions as F

from corpusloom import catalog
from corpusloom.functions import text as X
from corpusloom.operators import dedup, governance, packing
from corpusloom.sources import files

SMALL = "/root/testdata/sf0.001"
CHEAP = "doc_scan_validate normalize_text exact_dedup shingles near_dup_pairs quality_metrics_ref contamination_pairs_ref dedup_confusion_ref truth_violations pii_phone quality_reasons mix_select token_offsets pack_provenance pack_sequences hash_split split_check partition_files task_recovery_summary feed_integrity resume_equivalence shard_domains ab_one_sided shard_stats skew_improvement batch_schedule latency_percentiles line_offset_index failure_topk masked_mean content_fingerprint sequence_contract_check".split()


@pytest.mark.parametrize("name", CHEAP)
def test_against_sql(spark, name):
    assert differ(spark, views(SMALL), SMALL, catalog.queries()[name], catalog.oracle_sql()[name]) == ""


def test_packed_windows_have_each_text_once(spark):
    q = catalog.queries()
    n = q["packing_metrics"](spark, SMALL).first()
    got = q["pack_sequences"](spark, SMALL).agg(F.count("*").alias("n"), F.sum("trainable").alias("t")).first()
    first = q["exact_dedup"](spark, SMALL).join(q["token_offsets"](spark, SMALL), "source_id").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).first()
    assert (got.n, got.t) == (n.n_sequences, n.trainable_tokens) and first.t == n.total_tokens
    assert first.n == q["exact_dedup_stats"](spark, SMALL).first().n_unique == q["token_offsets"](spark, SMALL).count()


def test_first_rows_are_first_occurrences(spark):
    rows = [("d", 1, "same", None), ("b", 1, "same", "y"), ("a", 2, "same", "z"), ("c", 0, "other", "w")]
    docs = spark.createDataFrame(rows, "source_id string, pos long, text string, domain string")
    kept = {tuple(r) for r in dedup.first_rows(docs, "source_id", "domain", "text").collect()}
    assert kept == {("b", "y", "same"), ("c", "w", "other")}
    assert {r.source_id for r in dedup.first_occurrences(docs).collect()} == {x[0] for x in kept}
    nameless = docs.where("source_id IN ('d', 'a')")  # a null in the first row is kept, not passed over
    assert dedup.first_rows(nameless, "domain").first().domain is None


def test_every_query_has_a_name_and_sql_has_its_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_normalize(spark):
    rows = spark.createDataFrame([(" ＡＩ \r\n\r\n data \t x ",), ("é",), (None,), ("",)], "text string")
    assert [r[0] for r in rows.select(X.normalize("text")).collect()] == ["AI\ndata x", "é", None, ""]


def test_shingles_and_jaccard(spark):
    rows = spark.createDataFrame([("a b c d", "A b, c d"), ("a b", "a b c"), ("", "!"), (None, "x")], "a string, b string")
    got = [r[0] for r in rows.select(X.jaccard(X.shingle_hashes("a", 3), X.shingle_hashes("b", 3))).collect()]
    assert got == [r[0] for r in rows.select(X.jaccard(X.shingles("a", 3), X.shingles("b", 3))).collect()]
    assert got[:3] == [1.0, 0.0, 1.0]


def test_similar_pairs_match_brute_force(spark):
    base = "one two three four five six seven eight nine ten eleven twelve"
    texts = {"a": base, "b": base + " extra", "c": "zero " + base, "d": "other words entirely that share nothing with it", "e": base, "f": ""}
    classes, members = dedup.shingle_classes(spark.createDataFrame(list(texts.items()), "source_id string, text string"), 3)
    assert {tuple(r) for r in members.collect()} >= {("a", "a"), ("e", "a")}
    runs = {k: {tuple(v.split()[i : i + 3]) for i in range(len(v.split()) - 2)} for k, v in texts.items() if k != "e"}
    want = {(x, y) for x in runs for y in runs if x < y and runs[x] | runs[y] and len(runs[x] & runs[y]) / len(runs[x] | runs[y]) >= 0.8}
    assert {(r[0], r[1]) for r in dedup.similar_pairs(classes, threshold=0.8).collect()} == want


def test_clusters_of_a_chain(spark):
    v = spark.range(40).select(F.format_string("%03d", "id").alias("source_id"))
    pairs = spark.range(29).select(F.format_string("%03d", F.col("id") + 1).alias("left_source_id"), F.format_string("%03d", "id").alias("right_source_id"))
    got = dict(map(tuple, dedup.connected(v, pairs).collect()))
    assert {k for k, c in got.items() if c == "000"} == {f"{i:03d}" for i in range(30)} and got["035"] == "035"


def test_token_windows_are_the_stream(spark):
    docs = spark.createDataFrame([("x", 0, "abcde"), ("y", 1, "中"), ("z", 2, "fg")], "doc string, pos long, text string").withColumn("n_tokens", (F.octet_length("text") + 2).cast("long"))
    rows = sorted(packing.token_windows(packing.offsets(docs), 4).collect())
    stream = [t for x in ("abcde", "中", "fg") for t in [1, *(b + 4 for b in x.encode()), 2]]
    assert [r.input_ids for r in rows] == [(stream[i : i + 4] + [0] * 4)[:4] if i + 4 <= len(stream) - 1 else (stream[i:] + [0] * 4)[:4] for i in range(0, len(stream) - 1, 4)]
    assert sum(sum(r.loss_mask) for r in rows) == len(stream) - 1


def test_quotas(spark):
    got = governance.quotas(spark.createDataFrame([("a", 0.5), ("b", 0.25), ("c", 0.25)], "source string, weight double"), spark.createDataFrame([(10,)], "total long")).collect()
    assert {r.source: r.quota for r in got} == {"a": 5, "b": 3, "c": 2}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "source_id string, text string")
    classes, members = dedup.shingle_classes(none, 5)
    assert classes.count() == members.count() == dedup.similar_pairs(classes).count() == 0


def test_json_scan_reports_violations(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"source_id": "a", "text": "t", "metadata": {"k": 1}}\n{"source_id": "", "text": "t"}\n{"source_id": "b", "text": " "}\nnot json\n')
    good, bad = files.read_documents(spark, str(tmp_path / "x.jsonl"))
    assert [r.source_id for r in good.collect()] == ["a"]
    assert sorted(r.violation for r in bad.collect()) == ["no_source_id", "no_text", "unreadable"]


def test_stream_matches_batch(spark, tmp_path):
    from corpusloom.streaming.feed import shard_stream

    df = spark.range(20).repartition(3)
    files.write_parquet(df, str(tmp_path / "in"))
    q = shard_stream(spark, str(tmp_path / "in"), df.schema).writeStream.format("memory").queryName("seen").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.id for r in spark.table("seen").collect()) == list(range(20))


def test_sequential_scan_reads_every_byte(spark, tmp_path):
    for n in ("raw_documents", "lab04", "documents"):
        shutil.copy(f"{SMALL}/{n}.parquet", tmp_path)
        (tmp_path / f"{n}.parquet").chmod(0o600)
    held = {p: p.read_bytes() for p in sorted(tmp_path.glob("*.parquet"))}
    blocks = sorted(files.sequential_bytes(spark, [str(p) for p in held], 1000).collect())
    assert [r.sha256 for r in blocks] == [hashlib.sha256(x[i : i + 1000]).hexdigest() for x in held.values() for i in range(0, len(x), 1000)]
    scan = catalog.queries()["seq_scan_bytes"]
    first = scan(spark, str(tmp_path)).first()
    assert (first.n_files, first.n_bytes) == (3, sum(map(len, held.values())))
    assert first.sha256 == hashlib.sha256("".join(hashlib.sha256(x).hexdigest() for x in held.values()).encode()).hexdigest()
    last = [*held][-1]
    last.write_bytes(held[last][:5000] + bytes([held[last][5000] ^ 1]) + held[last][5001:])
    assert scan(spark, str(tmp_path)).first().sha256 != first.sha256


def test_sample_is_read_through_the_index(spark, tmp_path):
    from corpusloom.operators import feed

    rows = [("a", 2, "x", "zwei\nZeilen"), ("a", 1, "y", "ä"), ("b", 1, "z", "中"), ("a", 3, "w", "last")]
    lines = spark.createDataFrame(rows, "path string, order long, source_id string, text string")
    files.write_lines(lines, str(tmp_path / "lines"))
    index = feed.line_index(lines, "path", "order", "text", "source_id")
    got = files.read_lines(spark, index, str(tmp_path / "lines")).collect()
    assert {r.source_id: bytes(r.line).decode() for r in got} == {x[2]: x[3] + "\n" for x in rows}
    (file,) = (tmp_path / "lines" / "path=b").glob("*.txt")
    for held, why in ((b"x", "1 of 4 bytes"), (b"", "no lines in")):
        file.write_bytes(held)
        with pytest.raises(Exception, match=why):
            files.read_lines(spark, index, str(tmp_path / "lines")).collect()


def test_sample_query_reads_files(spark, monkeypatch):
    read = []
    monkeypatch.setattr(files, "read_lines", lambda s, index, root, f=files.read_lines: read.append(Path(root.removeprefix("file://"))) or f(s, index, root))
    assert differ(spark, views(SMALL), SMALL, catalog.queries()["random_sample_read"], catalog.oracle_sql()["random_sample_read"]) == ""
    assert any(read[0].glob("path=*/*.txt"))


def test_shortage_of_each_source(spark):
    docs = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("b", 4), ("b", 5)], "source string, doc_id long")
    quota = spark.createDataFrame([("a", 0.6, 3), ("b", 0.2, 1), ("c", 0.2, 1)], "source string, weight double, quota long")
    got = {r.source: (r.quota, r.available, r.missing) for r in governance.shortages(docs, quota).collect()}
    assert got == {"a": (3, 2, 1), "b": (1, 3, 0), "c": (1, 0, 1)}
    assert governance.selected(docs, quota, 1).count() == sum(q - m for q, _, m in got.values())


def test_shortage_accounts_for_the_mix(spark):
    q = catalog.queries()
    assert differ(spark, views(SMALL), SMALL, q["mix_shortage"], catalog.oracle_sql()["mix_shortage"]) == ""
    rows = q["mix_shortage"](spark, SMALL).collect()
    assert sum(r.quota - r.missing for r in rows) == q["mix_select"](spark, SMALL).count()


@pytest.mark.parametrize("n", [0, 1, 2, 4, 25, 300])
def test_split_has_its_size(spark, n):
    ids = [str(i) for i in range(n)]
    h = {i: hashlib.sha256(f"42:{i}".encode()).hexdigest() for i in ids}
    rows = spark.createDataFrame([(i, h[i]) for i in ids], "source_id string, h string")
    got = {r.source_id for r in governance.split(rows, 0.1).where("part = 'validation'").collect()}
    assert got == set(sorted(ids, key=h.get)[: max(1, min(n - 1, round(n * 0.1)))])


def test_split_of_the_table(spark):
    parts = [r.part for r in catalog.queries()["hash_split"](spark, SMALL).collect()]
    assert parts.count("validation") == round(len(parts) * 0.1)


@pytest.mark.parametrize("threshold", [0.45, 0.8])
def test_leaks_by_broadcast_and_by_prefixes(spark, threshold):
    words = [f"w{i}" for i in range(40)]
    left = [(f"l{i}", " ".join(words[i : i + 12])) for i in range(20)] + [("none", "!!")]
    right = [(f"r{i}", " ".join([*words[i : i + 11], "other"])) for i in range(0, 20, 5)] + [("empty", "?")]
    a, b = (dedup.shingle_classes(spark.createDataFrame(x, "source_id string, text string"), 3)[0] for x in (left, right))
    runs = lambda t: {tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)}
    want = {(x, y) for x, s in left[:-1] for y, u in right[:-1] if len(runs(s) & runs(u)) / len(runs(s) | runs(u)) >= threshold} | {("none", "empty")}
    assert want == {tuple(r)[:2] for r in dedup.similar_pairs(a, b, threshold).collect()} == {tuple(r)[:2] for r in dedup.similar_pairs(a, b, threshold, broadcast_postings=0).collect()}


def test_phone_marks(spark):
    texts = ["8613812345678", "+8613812345678", "+86 13812345678", "x13812345678y", "213812345678", "138123456789", "12812345678"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "text string").select(X.has_phone("text")).collect()]
    assert got == [True, True, True, True, False, False, False]


def test_windows_of_a_huge_stream(spark):
    q = packing.sequences(spark.createDataFrame([(3 * 10**9 + 1,)], "total long"), 1024)
    assert q.count() == -(-3 * 10**9 // 1024) and q.rdd.getNumPartitions() > 1
    assert "Generate" in packing.sequences(spark.createDataFrame([(3 * 10**12,)], "total long"))._jdf.queryExecution().toString()
    assert packing.sequences(spark.createDataFrame([(1,)], "total long")).count() == packing.sequences(spark.createDataFrame([(0,)], "total long")).count() == 0


def test_mix_with_a_hot_source(spark):
    docs = spark.range(2000).select(F.when(F.col("id") < 1800, "hot").otherwise("cold").alias("source"), F.col("id").alias("doc_id"))
    quota = spark.createDataFrame([("hot", 700), ("cold", 50)], "source string, quota long")
    got = governance.selected(docs, quota, 1).collect()
    h = {i: hashlib.sha256(f"1:{i}".encode()).hexdigest() for i in range(2000)}
    assert {r.doc_id for r in got if r.source == "hot"} == set(sorted(range(1800), key=h.get)[:700])
    assert sorted(r["rank"] for r in got if r.source == "cold") == [*range(1, 51)]
    assert {r.doc_id: r["rank"] for r in governance.selected(docs, quota, 1, digits=5).collect()} == {r.doc_id: r["rank"] for r in got}
    with pytest.raises(ValueError, match="hot lacks 200"):
        governance.required(docs, spark.createDataFrame([("hot", 2000)], "source string, quota long"))


def test_weights_are_checked(spark):
    for rows in ([("a", 0.5), ("b", 0.4)], [("a", 1.5), ("b", -0.5)]):
        with pytest.raises(ValueError, match="weights"):
            governance.weights_checked(spark.createDataFrame(rows, "source string, weight double"))


def test_percentiles_with_a_hot_group(spark):
    from corpusloom.operators import feed

    rows = [("hot", float((i * 7919) % 1000)) for i in range(900)] + [("cold", 1.0), ("cold", 3.0), ("cold", None), ("one", 5.0)]
    got = {r.g: (r.n, r.p50, r.p99, r["median"]) for r in feed.percentiles(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    hot = sorted(v for g, v in rows if g == "hot")
    assert got == {"hot": (900, hot[round(899 * 0.5)], hot[round(899 * 0.99)], (hot[449] + hot[450]) / 2), "cold": (2, 1.0, 3.0, 2.0), "one": (1, 5.0, 5.0, 5.0)}


def test_settings_are_refused():
    from corpusloom import settings

    for kind, wrong in ((settings.Audit, {"words": 0}), (settings.Audit, {"similarity": 1.2}), (settings.Audit, {"licenses": ()}), (settings.Version, {"length": 1}), (settings.Compute, {"failing": 8}), (settings.Compute, {"hot_share": 1.0}), (settings.Feed, {"batch": 0}), (settings.Storage, {"writers": 0}), (settings.Comparison, {"seeds": (1, 1)})):
        with pytest.raises(ValueError):
            kind(**wrong)


def test_attempts_and_markers(spark, tmp_path):
    from corpusloom.operators import recovery

    files.write_partitions(spark.range(100).select("id", (F.col("id") % 4).cast("int").alias("part")), str(tmp_path / "in"), "part")
    found = files.listed(spark, str(tmp_path / "in"), "/part=([0-9]+)/", "p").select(F.col("p").cast("int").alias("part"), "paths")
    rows = recovery.run_with_retry(spark, found, f"file://{tmp_path}/markers", 3).collect()
    assert sorted((r.round, r.part, r.done, r.reused, r.n_rows) for r in rows) == [(1, k, k != 3, False, 25 * (k != 3)) for k in range(4)] + [(2, 3, True, False, 25)] + [(3, k, True, True, 25) for k in range(4)]
    (tmp_path / "markers" / "part-00001.done.json").unlink()
    assert {r.part for r in recovery.attempt(found, f"file://{tmp_path}/markers", None).collect() if not r.reused} == {1}


def test_order_by_ids_and_batches(spark):
    from corpusloom.operators import feed

    rows = spark.range(5).select("id", F.concat(F.lit("x"), F.col("id")).alias("v"))
    ids = spark.createDataFrame([(3, 0), (1, 1), (3, 2)], "id long, position int")
    assert [r.v for r in feed.ordered_by(rows, ids).collect()] == ["x3", "x1", "x3"]
    with pytest.raises(Exception, match="no row for 9"):
        feed.ordered_by(rows, spark.createDataFrame([(9, 0)], "id long, position int")).collect()
    assert [len(b) for b in feed.batches(rows, 2)] == [2, 2, 1]


def test_scope_removes_stages(spark):
    from corpusloom.session import Stages, scope

    with scope(spark):
        path = Path(Stages(spark).write(spark.range(3))._loom_path.removeprefix("file:"))
        assert path.exists()
    assert not path.exists()


@pytest.mark.parametrize("lab", ["feed", "comparison"])
def test_labs_run_validate_and_notice_changes(spark, tmp_path, lab):
    from corpusloom import labs

    out, q = str(tmp_path), catalog.queries()
    first = labs.run(spark, q, lab, SMALL, out)
    assert labs.run(spark, q, lab, SMALL, out) == first == labs.validate(spark, q, lab, SMALL, out)
    assert (tmp_path / lab / "card.md").read_text().startswith(f"# {lab}")
    manifest = tmp_path / lab / "manifest.json"
    held = manifest.read_text()
    manifest.write_text(held.replace('"rows": 1', '"rows": 2'))
    with pytest.raises(ValueError, match="fingerprint"):
        labs.validate(spark, q, lab, SMALL, out)
    manifest.write_text(held)
    name = labs.LABS[lab][0]
    files.write_parquet(spark.range(1), f"{out}/{lab}/{name}")
    with pytest.raises(ValueError, match=name):
        labs.validate(spark, q, lab, SMALL, out)


def test_state_hash():
    import numpy as np

    from corpusloom.labs import state_hash

    x = {"a": [1, 2.0], "b": np.arange(3)}
    assert state_hash(x) == state_hash({"b": np.arange(3), "a": [1, 2.0]}) and len({state_hash(v) for v in (x, {"a": [1, 2], "b": np.arange(3)}, {"a": [1, 2.0], "b": np.arange(4)}, [1, [2]], [1, 2])}) == 5


def test_command_line(capsys):
    from corpusloom import labs
    from corpusloom.__main__ import RUN, VALIDATE, main

    assert main(["environment"]) == 0 and "/root" not in capsys.readouterr().out
    assert main(["list"]) == 0 and "quality_metrics_ref" in capsys.readouterr().out
    assert set(RUN.values()) == set(VALIDATE.values()) == set(labs.LABS) and {x for own in labs.LABS.values() for x in own} <= set(catalog.queries())
