import json

import pytest

from granary.errors import ConnectorContractError, ConnectorRegistrationError, DatasetIntegrityError, UnsupportedCapability
from granary.functions import hashing
from granary.operators import audit, checks
from granary.sources import connectors, dataset, files
from pyspark.sql import functions as F

META = '{"source_identity": "%s", "source_fingerprint": "f", "k": 1, "document_filepath": "/x"}'
ROWS = [("a:0", "a", 0, "first text", {"metadata": META % "a"}), ("a:1", "a", 1, "second text", {"metadata": META % "a"}), ("b:0", "b", 0, "third text", {"metadata": META % "b"})]


def changed(rows, **by_id):
    return [by_id.get(r[0].replace(":", ""), r) for r in rows if by_id.get(r[0].replace(":", ""), r)]


@pytest.mark.parametrize(
    "backend, statuses, signals",
    [
        (ROWS, ["unchanged"] * 3, {}),
        ([("z:0", *ROWS[0][1:]), *ROWS[1:]], ["id_changed", "unchanged", "unchanged"], {"chunk_ids_changed": 1}),
        (changed(ROWS, b0=()), ["missing", "unchanged", "unchanged"], {"chunks_missing": 1, "documents_removed": 1}),
        ([*ROWS, ("c:0", "c", 0, "new", {"metadata": META % "c"})], ["added", "unchanged", "unchanged", "unchanged"], {"chunks_added": 1, "documents_added": 1}),
        (changed(ROWS, b0=("b:0", "b", 0, "other", {"metadata": META % "b"})), ["text_changed", "unchanged", "unchanged"], {"chunk_text_changed": 1}),
        (changed(ROWS, a1=("a:1", "a", 1, "second text", {"metadata": '{"k": 2, "n": 0}'})), ["unchanged"] * 3, {"chunk_metadata_changed": 1, "metadata_keys_added": 1}),
        (changed(ROWS, a1=("a:1", "b", 5, "second text", {"metadata": META % "a"})), ["unchanged"] * 3, {"chunk_fields_changed": 1}),
        ([("x:0", *ROWS[0][1:]), ("x:1", *ROWS[0][1:]), *ROWS[1:]], ["ambiguous", "unchanged", "unchanged"], {"chunks_ambiguous": 1, "documents_chunk_count_changed": 1}),
    ],
)
def test_audit_names_the_change(chunk_frame, backend, statuses, signals):
    found = audit.audit(chunk_frame(ROWS), chunk_frame(backend))
    assert sorted(r.status for r in found.chunks.collect()) == statuses
    assert found.signals == signals and found.in_sync == (not signals)


def test_audit_refuses_repeated_ids(chunk_frame):
    with pytest.raises(ConnectorContractError):
        audit.audit(chunk_frame(ROWS), chunk_frame([*ROWS, ROWS[0]]))


def test_lite_checks(chunk_frame):
    other = chunk_frame([("a:0", "q", 0, "first text"), ("a:1", "a", 3, "else"), ("n:0", "n", 0, "x")])
    assert sorted(map(tuple, audit.structure(chunk_frame(ROWS), other).collect())) == [("a:0", "moved_document"), ("a:1", "moved_position"), ("b:0", "missing"), ("n:0", "added")]
    one = audit.sampled_text_changes(chunk_frame(ROWS), other, 100, 7)
    assert sorted(map(tuple, one.collect())) == [("a:0", "same"), ("a:1", "text_changed"), ("b:0", "missing")]
    assert audit.sampled_text_changes(chunk_frame(ROWS), other, 1, 7).count() == 1
    ids = [f"i{k}" for k in range(10)]
    assert audit.sample_ids(ids, 0.1, 3) == audit.sample_ids(ids[::-1], 0.1, 3) and len(audit.sample_ids(ids, 0.1, 3)) == 1


def test_profile(chunk_frame):
    rows = [(f"c{i}", "d", i, "x" * i + "shared end") for i in range(1, 11)]
    p = audit.profile(chunk_frame(rows)).first()
    assert (p.chunks, p.min, p.max, p.p90, p.pairs) == (10, 11, 20, 20, 9)
    rows = [("a", "d", 0, "some words overlap here"), ("b", "d", 1, "overlap here and on")]
    assert audit.profile(chunk_frame(rows)).first().overlap_max == 12


# Datasets ------------------------------------------------------------------------------


def test_dataset_round_trip_and_tampering(spark, chunk_frame, tmp_path):
    out = str(tmp_path / "ds")
    made = dataset.write(chunk_frame(ROWS), out, "test", {"method": "x"}, interchange=True)
    assert made.verified and made.manifest["chunk_count"] == 3 and made.manifest["sources"]["source_count"] == 2
    assert made.chunks.where(F.col("metadata").contains("document_filepath")).count() == 0
    back = files.read_chunks_jsonl(spark, f"{out}/data/chunks.jsonl")
    assert hashing.chunk_inventory_sha256(back) == made.manifest["chunk_inventory_sha256"]
    with pytest.raises(FileExistsError):
        dataset.write(chunk_frame(ROWS), out, "test", {})
    dataset.write_envelope(made, "analysis", "tool", {"n": 1})
    assert dataset.list_envelopes(made, "analysis")[0]["problems"] == []
    found = audit.audit(made.chunks, chunk_frame(ROWS[:2]))
    audit_id = dataset.record_audit(made, found, "table")
    assert dataset.list_audits(made)[0]["signals"] == {"chunks_missing": 1, "documents_removed": 1}
    synced = dataset.sync(made, chunk_frame(ROWS[:2]), str(tmp_path / "next"), audit_id)
    assert synced.manifest["derived_from"]["dataset_id"] == made.dataset_id
    with pytest.raises(DatasetIntegrityError):
        dataset.sync(made, chunk_frame(ROWS), str(tmp_path / "third"), "audit-none")
    manifest = json.loads((tmp_path / "ds/dataset.json").read_text())
    manifest["name"] = "other"
    (tmp_path / "ds/dataset.json").write_text(json.dumps(manifest))
    with pytest.raises(DatasetIntegrityError):
        dataset.read(spark, out)
    assert not dataset.read(spark, out, verify=False).verified


@pytest.mark.parametrize("row", [("a:0", "a", 2, "again"), ("x", "", 0, "no document"), ("x", "d", None, "no place"), ("x", "d", 0, "  "), (None, "d", 0, "no id")])
def test_contract_is_checked(chunk_frame, tmp_path, row):
    with pytest.raises(DatasetIntegrityError):
        dataset.write(chunk_frame([*ROWS, row]), str(tmp_path / "x"), "n", {})


def test_lines_hash_is_the_stated_one(chunk_frame):
    import hashlib

    lines = "".join(f"{r[0]}\t{hashlib.sha256(r[3].encode()).hexdigest()}\n" for r in ROWS)
    assert hashing.lines_sha256(hashing.inventory_lines(chunk_frame(ROWS[::-1])), "chunk_id") == hashlib.sha256(lines.encode()).hexdigest()


def test_identity_depends_on_rows_only(chunk_frame, spark, tmp_path):
    a, b = chunk_frame(ROWS), chunk_frame(ROWS[::-1]).repartition(3)
    assert hashing.chunk_inventory_sha256(a) == hashing.chunk_inventory_sha256(b) != hashing.chunk_inventory_sha256(a.limit(2))
    assert hashing.chunk_inventory_sha256(a.limit(0))
    made = dataset.write(a, str(tmp_path / "t"), "n", {})
    assert made.manifest["inventory_method"] == "tree" and dataset.read(spark, made.path).verified


def test_legacy_layout(spark, chunk_frame, tmp_path):
    made = dataset.write(chunk_frame(ROWS), str(tmp_path / "ds"), "n", {}, interchange=True)
    (tmp_path / "old").mkdir()
    (tmp_path / "ds/data/chunks.jsonl").rename(tmp_path / "old/chunks.jsonl")
    old = dataset.read_legacy(spark, str(tmp_path / "old"))
    assert not old.verified and old.warnings and hashing.chunk_inventory_sha256(old.chunks) == made.manifest["chunk_inventory_sha256"] and old.sources.count() == 2
    with pytest.raises(DatasetIntegrityError):
        dataset.read_legacy(spark, str(tmp_path / "none"))


def test_bad_lines(spark, tmp_path):
    for i, line in enumerate(['{"chunk_id": "a", "surprise": 1}', "not json", "[1]"]):
        (tmp_path / f"{i}.jsonl").write_text(line + "\n")
        with pytest.raises(DatasetIntegrityError):
            files.read_chunks_jsonl(spark, str(tmp_path / f"{i}.jsonl")).collect()


def test_folder(spark, tmp_path):
    (tmp_path / "in/Sub dir+x").mkdir(parents=True)
    (tmp_path / "in/.git").mkdir()
    (tmp_path / "in/Sub dir+x/A.MD").write_bytes(b"\xef\xbb\xbf# T\r\nline\rend")
    (tmp_path / "in/b.txt").write_text("plain")
    (tmp_path / "in/.git/c.txt").write_text("hidden")
    (tmp_path / "in/d.exe").write_text("no")
    docs = {r.source_identity: r for r in files.load_documents(spark, str(tmp_path / "in")).collect()}
    assert set(docs) == {"sub dir+x/a.md", "b.txt"} and docs["sub dir+x/a.md"].content == "# T\nline\nend" and docs["sub dir+x/a.md"].relative_path == "Sub dir+x/A.MD"
    (tmp_path / "in/bad.txt").write_bytes(b"\xff\xfe\xff")
    with pytest.raises(Exception, match="bad.txt"):
        files.load_documents(spark, str(tmp_path / "in")).collect()


# Connectors ------------------------------------------------------------------------------


def embed(texts):
    return [[float(len(t)), float(t.count("t")), 1.0] for t in texts]


def test_store_and_conformance(spark, chunk_frame, tmp_path):
    path = str(tmp_path / "store")
    store = connectors.provision(chunk_frame(ROWS), path, embed)
    queries = spark.createDataFrame([("q", [10.0, 2.0, 1.0])], "query_id string, vector array<double>")
    report = checks.validate_connector(store, queries, connection={"path": path})
    assert checks.ready(report), report.where("status = 'fail'").collect()
    assert store.query(queries, 2).count() == 2 and store.query(queries, 5, {"doc_id": "b"}).count() == 1
    with pytest.raises(ConnectorContractError):
        connectors.provision(chunk_frame(ROWS[:1]), path, embed, append=True)
    assert connectors.provision(chunk_frame([("n:0", "n", 0, "new")]), path, embed, append=True).count() == 4
    with pytest.raises(UnsupportedCapability):
        store.need("generate")


class Broken(connectors.TableConnector):
    def query(self, queries, top_k=None, filter=None):
        hits = super().query(queries, 5)
        return hits.withColumn("rank", F.col("rank") + 1).withColumn("chunk_id", F.lit("ghost"))

    def counts(self):
        return 0


def test_broken_store_is_named(spark, chunk_frame, tmp_path):
    path = str(tmp_path / "store")
    connectors.provision(chunk_frame([*ROWS, ("a:9", "a", 9, "gap")]), path, embed)
    report = checks.validate_connector(Broken(spark, path), spark.createDataFrame([("q", [1.0, 1.0, 1.0])], "query_id string, vector array<double>"), 2, {"api_key": "x"})
    status = {r.name: r.status for r in report.collect()}
    assert status["query"] == status["ordinals"] == status["connection"] == "fail" and status["method names"] == "warn" and status["corpus"] == "pass"


def test_registry(spark, tmp_path):
    with pytest.raises(ConnectorRegistrationError):
        connectors.register(connectors.ConnectorSpec("Bad Name", "x", lambda s: None))
    with pytest.raises(ConnectorRegistrationError):
        connectors.register(connectors.ConnectorSpec("table", "x", lambda s: None))
    with pytest.raises(ConnectorRegistrationError):
        connectors.connect(spark, "none", {})
    with pytest.raises(ConnectorContractError):
        connectors.connect(spark, "table", {"top_k": 3})
    assert connectors.discover() == {} and "table" in connectors.specs()
    with pytest.raises(ConnectorContractError):
        connectors.validate_snapshot({"a": [{"my_token": 1}]})
    with pytest.raises(ConnectorContractError):
        connectors.validate_snapshot({"a": float("nan")})


def page_factory():
    rows = [{"chunk_id": f"c{i}", "doc_id": "d", "source_file": "d", "doc_chunk_index": i, "text": "t", "metadata": "{}"} for i in range(25)]

    def page(cursor):
        at = int(cursor or 0)
        return rows[at : at + 10], str(at + 10) if at + 10 < 25 else None

    return page


def test_paged_source(spark):
    spark.dataSource.register(connectors.PagedSource)
    df = spark.read.format("granary_paged").option("factory", "test_drift_and_data:page_factory").load()
    assert df.count() == 25 and df.select("chunk_id").distinct().count() == 25
