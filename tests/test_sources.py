import json
import os

import pandas as pd
import pytest
from fixtures import EXPORT, HARMLESS, PROFILE
from pyspark.sql import functions as F

from suite.docx_build import docx_bytes
from suite.queries import QUERIES
from veilscan.operators import columns as cols
from veilscan.operators.recognisers import general_recognisers, india_recognisers
from veilscan.plans.config import ScanSpec, load_spec, output_location, rules_for, spec_from
from veilscan.plans.scan import scan_all, scan_files, scan_records
from veilscan.sources import docx
from veilscan.sources import tables as tb
from veilscan.sources.databases import catalog_tables, database_findings, read_databases
from veilscan.sources.docx import document_text
from veilscan.sources.files import FileOutput, Location, read_files
from veilscan.sources.listing import contents, directories, listed_files, opens
from veilscan.sources.records import PYTHON_BATCH, SLIM_ROWS, small_batches, spread_slim, text_records, union_all
from veilscan.streaming.scan import stream_findings


def put(root, name, data):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as handle:
        handle.write(data if isinstance(data, bytes) else data.encode())
    return path


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tree"))
    put(root, "in/profile.txt", PROFILE)
    put(root, "in/dirty.TXT", b"A\xff\xfeB\r\nC\rD \xef\xbf\xbd")
    put(root, "in/valid.txt", "keeps �\r\nline".encode())
    put(root, "in/with space+%41é.json", EXPORT)
    put(root, "in/blank.md", " \n\t ")
    put(root, "in/deep/er/notes.log", HARMLESS)
    put(root, "in/node_modules/x/profile.txt", PROFILE)
    put(root, "in/deep/node_modules.txt", HARMLESS)
    put(root, "in/skip.pyc", PROFILE)
    put(root, "in/binary.dat", bytes(range(256)))
    put(root, "in/picture.png", PROFILE)
    put(root, "in/big.csv", "x" * 3_000_000)
    put(root, "in/good.docx", docx_bytes("Customer PAN ABCDE1234F\nsecond & <third>"))
    put(root, "in/broken.docx", b"no archive")
    put(root, "in/out/output.json", PROFILE)
    return root


def by_name(records):
    return {r["source_path"]: r for r in records.collect()}


def test_file_records(spark, tree):
    root = f"{tree}/in"
    out = FileOutput(mask_mode="relative", base_dirs=(root,), report_path=f"{root}/out/output.json")
    got = by_name(read_files(spark, [Location(input_paths=(root, "/absent/path"), max_file_size_mb=1)], out))
    assert set(got) == {
        "profile.txt", "dirty.TXT", "valid.txt", "with space+%41é.json", "blank.md", "deep/er/notes.log",
        "deep/node_modules.txt", "picture.png", "big.csv", "good.docx", "broken.docx",
    }
    assert got["dirty.TXT"]["text"] == "AB\nC\nD "
    assert got["valid.txt"]["text"] == "keeps �\nline"
    assert got["picture.png"]["text"] == ""
    assert got["good.docx"]["text"] == "Customer PAN ABCDE1234F\nsecond & <third>"
    assert got["broken.docx"]["record_type"] == "error" and "BadZipFile" in got["broken.docx"]["reason"]
    assert got["big.csv"]["record_type"] == "skip" and got["big.csv"]["reason"] == "File larger than max_file_size_mb (1)"
    assert got["big.csv"]["metadata"]["file_size_bytes"] == 3_000_000 and got["dirty.TXT"]["metadata"]["extension"] == ".txt"
    import hashlib

    assert got["profile.txt"]["content_hash"] == hashlib.sha256(PROFILE.encode()).hexdigest()


def test_failed_files_are_rows_of_their_own(spark, tmp_path):
    """A link to nothing, a file whose bytes can't be read and a pipe fail alone; where a filter leaves them out, or they are too large, nothing is opened."""
    root = str(tmp_path / "in")
    for k in range(9):
        put(root, f"{k}.txt", PROFILE)
    os.symlink(f"{root}/absent", f"{root}/gone.txt")
    os.symlink("/proc/self/mem", f"{root}/unread.txt")
    os.mkfifo(f"{root}/pipe.txt")
    rows = by_name(read_files(spark, [Location(input_paths=(root,))], FileOutput(mask_mode="basename")))
    assert sum(r["record_type"] == "source" and r["text"] == PROFILE for r in rows.values()) == 9
    for name, reason in (("gone.txt", "No such file"), ("unread.txt", "Input/output error"), ("pipe.txt", "Not a regular file")):
        assert rows[name]["record_type"] == "error" and reason in rows[name]["reason"] and rows[name]["text"] is None and rows[name]["content_hash"] is None
    assert len(rows) == 12
    few = Location(input_paths=(root,), exclude_file_globs=("gone*", "unread*", "pipe*"))
    assert {r["record_type"] for r in read_files(spark, [few]).collect()} == {"source"}
    counts = scan_files(spark, ScanSpec(rules_for("default"), locations=(Location(input_paths=(root,)),))).stats.first()
    assert counts["files_failed"] == 3 and counts["files_scanned"] == 9


def test_pruned_trees_are_never_looked_into(spark, tmp_path):
    for name in ("a.txt", "node_modules/deep/er/x.txt", "src/node_modules/y.txt", "src/.hidden/z.txt", "src/key=1/_w.txt"):
        put(str(tmp_path), f"in/{name}", PROFILE)
    root = str(tmp_path / "in")
    os.symlink(root, f"{root}/src/loop")
    seen = directories(spark, root, root, ("node_modules",))
    assert sorted(d[len(root) :] for d in seen) == ["", "/src", "/src/.hidden", "/src/key=1"]
    uri = f"file://{root}"
    for spelling in (root, uri, f"file:{root}"):
        rows = read_files(spark, [Location(input_paths=(spelling,))], FileOutput(mask_mode="relative", base_dirs=(root,))).collect()
        assert sorted(r["source_path"] for r in rows) == ["a.txt", "src/.hidden/z.txt", "src/key=1/_w.txt"]


def test_a_full_directory_is_dealt_to_many_tasks(spark, tmp_path):
    for k in range(300):
        put(str(tmp_path), f"in/{k}.txt", "x")
    files = listed_files(spark, str(tmp_path / "in"), True, ())
    read = contents(files, str(tmp_path / "in"), 10, document_text).withColumn("task", F.spark_partition_id())
    assert read.count() == 300 and read.select("task").distinct().count() > 1


def test_stores_that_only_spark_opens(spark, tmp_path):
    """A mounted view of a local tree stands for such a store: read by Spark's reader, documents included."""
    put(str(tmp_path), "in/a.txt", PROFILE)
    put(str(tmp_path), "in/good.docx", docx_bytes("Customer PAN ABCDE1234F"))
    put(str(tmp_path), "in/broken.docx", b"no archive")
    put(str(tmp_path), "in/big.csv", "x" * 3_000_000)
    put(str(tmp_path), "in/node_modules/y.txt", PROFILE)
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set("fs.viewfs.mounttable.probe.link./data", f"file://{tmp_path}")
    assert not opens("viewfs://probe/data/in") and opens(f"file://{tmp_path}/in") and not opens(f"{tmp_path}/absent")
    rows = by_name(read_files(spark, [Location(input_paths=("viewfs://probe/data/in",), max_file_size_mb=1)], FileOutput(mask_mode="basename")))
    assert {k: r["record_type"] for k, r in rows.items()} == {"a.txt": "source", "good.docx": "source", "broken.docx": "error", "big.csv": "skip"}
    assert rows["good.docx"]["text"] == "Customer PAN ABCDE1234F" and len(rows["good.docx"]["content_hash"]) == 64 and rows["a.txt"]["text"] == PROFILE


def test_flat_listing_single_file_and_binary(spark, tree):
    flat = by_name(read_files(spark, [Location(input_paths=(f"{tree}/in",), recursive=False)], FileOutput(mask_mode="basename")))
    assert "profile.txt" in flat and "notes.log" not in flat
    one = read_files(spark, [Location(input_paths=(f"{tree}/in/node_modules/x/profile.txt",))]).collect()
    assert len(one) == 1 and one[0]["text"] == PROFILE
    raw = Location(input_paths=(f"{tree}/in/binary.dat",), include_extensions=(), read_binary_files_as_text=True)
    assert read_files(spark, [raw]).first()["text"] == bytes(range(256)).decode("utf-8", errors="ignore")
    plain = Location(input_paths=(f"{tree}/in/binary.dat",), include_extensions=())
    assert read_files(spark, [plain]).first()["text"] == ""


def test_overlapping_inputs_are_kept_twice(spark, tree):
    twice = read_files(spark, [Location(input_paths=(f"{tree}/in/profile.txt", f"{tree}/in/profile.txt"))])
    assert twice.count() == 2 and twice.select("source_id").distinct().count() == 2


def test_location_rows(spark, tree):
    def reasons(*locations):
        return [(r["source_path"], r["reason"]) for r in read_files(spark, list(locations)).collect()]

    assert reasons(Location(enabled=False)) == [("filesystem://", "No enabled filesystem locations configured.")]
    nothing = [("filesystem://", "Filesystem locations are enabled but no files matched configured filters.")]
    assert reasons(Location(input_paths=(f"{tree}/absent",))) == nothing
    assert reasons(Location(input_paths=(f"{tree}/in",), include_extensions=(".none",))) == nothing
    refused = reasons(Location(name="cloud", provider="s3"))
    assert refused == [("filesystem://cloud", "Unsupported filesystem provider 's3'. Only provider=local is currently supported.")]


def test_scan_and_save(spark, tree, tmp_path):
    config = {
        "scan": {"input_paths": [f"{tree}/in"], "max_file_size_mb": 1},
        "output": {"path": f"{tree}/in/out", "mask_file_paths": True, "file_path_mask_mode": "relative"},
    }
    path = tmp_path / "config.json"
    path.write_text(json.dumps(config))
    spec = load_spec(str(path))
    assert spec.files.report_path == f"{tree}/in/out/output.json"
    saved = scan_files(spark, spec).save(str(tmp_path / "report"), ordered=True)
    findings = spark.read.json(str(tmp_path / "report/findings"))
    assert findings.filter("file_path = 'profile.txt'").count() == saved.findings.filter("file_path = 'profile.txt'").count() >= 8
    assert findings.filter("file_path = 'good.docx' and entity_type = 'IN_PAN'").first()["category"] == "SENSITIVE_PERSONAL"
    snippet = findings.filter("file_path = 'profile.txt' and entity_type = 'IN_PAN'").first()["snippet"]
    start = PROFILE.index("ABCDE1234F")
    assert snippet == PROFILE[start - 24 : start + 34]
    status = {r["file_path"]: r for r in spark.read.json(str(tmp_path / "report/sources")).collect()}
    assert status["blank.md"]["status"] == "scanned" and status["blank.md"]["findings_count"] == 0
    assert status["big.csv"]["status"] == "skipped" and status["big.csv"]["findings_count"] is None
    assert status["broken.docx"]["status"] == "failed" and status["broken.docx"]["error"]
    stats = spark.read.json(str(tmp_path / "report/stats")).first()
    assert (stats["files_scanned"], stats["files_skipped"], stats["files_failed"]) == (9, 1, 1)
    assert stats["total_findings"] == findings.count()
    assert spark.read.json(str(tmp_path / "report/plugins")).first()["findings"] == findings.count()
    assert spark.read.json(str(tmp_path / "report/run")).first()["environment"] == "default"


def test_sources_are_read_once_per_save(spark, tree, tmp_path):
    """A counter in the records' own plan: one row each, however many datasets are written; results equal the lazy ones."""
    spec = ScanSpec(rules_for("default"), locations=(Location(input_paths=(f"{tree}/in",), max_file_size_mb=1),), segment_chars=200)
    records, seen = read_files(spark, list(spec.locations)), spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    result = scan_records(records.mapInPandas(counted, records.schema), spec)
    saved = result.save(str(tmp_path / "once"), fmt="parquet")
    assert seen.value == records.count() and not [n for n in os.listdir(tmp_path / "once") if n.startswith("_scan")]
    plain = lambda frame: sorted(map(repr, frame.collect()))
    lazy = scan_records(records, spec)
    assert plain(saved.findings.select(lazy.findings.columns)) == plain(lazy.findings)
    written = spark.read.parquet(str(tmp_path / "once/sources"))
    assert plain(written.select(lazy.sources.columns)) == plain(lazy.sources)
    assert plain(spark.read.parquet(str(tmp_path / "once/stats"))) == plain(lazy.stats)


def test_config(tmp_path):
    rules = {"my_overrides": {"score_threshold": 0.9, "entities": ["EMAIL_ADDRESS"]}, "entities": {"EMAIL_ADDRESS": {"score_threshold": 0.95}}}
    (tmp_path / "base.json").write_text(json.dumps(rules))
    config = {
        "anything": {"entities": ["A"], "allow_list": ["x"], "chunk_size_chars": 0},
        "rule_engine": {"base_rules_file": "base.json", "environment_rules": {"qa": "base.json"}, "environment": "qa"},
        "sources": {"filesystem": {"locations": [{"provider": "LOCAL", "recursive": False, "input_paths": "one"}, {"enabled": False}]}},
        "output": {"include_text_snippet": False, "include_source_metadata": False},
    }
    spec = spec_from(config, str(tmp_path))
    assert spec.rules.entities == ("EMAIL_ADDRESS",) and spec.rules.min_score("EMAIL_ADDRESS") == 0.95
    assert spec.detect.allow_list == ("x",) and spec.detect.snippet_chars is None and spec.segment_chars == 0
    assert [(loc.name, loc.provider, loc.recursive, loc.enabled, loc.input_paths) for loc in spec.locations] == [
        ("filesystem_1", "local", False, True, ("one",)), ("filesystem_2", "local", True, False, (".",)),
    ]
    assert not spec.keep_source_metadata and spec.plugins == ("filesystem",)
    both = spec_from({"sources": {"enabled_sources": ["database"], "database": {"enabled": True}}})
    assert both.plugins == ("database",)
    with pytest.raises(FileNotFoundError):
        spec_from({"rule_engine": {"base_rules_file": "missing.json"}}, str(tmp_path))
    assert output_location(str(tmp_path)).endswith("/output.json") and output_location("new/dir") == "new/dir/output.json"
    assert output_location("a/report.json") == "a/report.json" and output_location("") == "output.json"


# ---- tables and columns -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def crm(spark):
    customers = spark.createDataFrame(
        [(1, "Asha Verma", "asha@example.in", "+91-9876543210", "4321 8765 2108", "ABCDE1234F", b"\xff blob"),
         (2, "John Miller", "john@example.org", "+1-202-555-0186", None, None, b"ok"),
         (3, "Ravi Rao", "ravi@example.in", "+91-9123456789", "2345 6789 0124", "PQRSV4321K", None)],
        "customer_id long, full_name string, email string, phone string, aadhaar string, pan string, scan binary",
    )
    payments = spark.createDataFrame(
        [(1, "4111-1111-1111-1111", "asha@okicici", "fast"), (2, "4012888888881881", "ravi@oksbi", "")],
        "payment_id long, card string, handle string, notes string",
    )
    return {"sales.customers": customers, "payments": payments}


def recognisers():
    return [*general_recognisers(), *india_recognisers({})]


def test_discovery(spark, crm):
    found = {(r["table"], r["column"], r["pii_type"]): r for r in cols.discover_columns(crm, recognisers()).collect()}
    assert found["customers", "email", "EMAIL_ADDRESS"]["by_value"] and found["customers", "email", "EMAIL_ADDRESS"]["by_name"]
    assert found["customers", "pan", "IN_PAN"]["non_null"] == 2 and found["customers", "pan", "IN_PAN"]["hit_rate"] == 1.0
    aadhaar = found["customers", "aadhaar", "IN_AADHAAR"]
    assert (aadhaar["hits"], aadhaar["by_value"], aadhaar["by_name"]) == (1, True, True)
    assert ("customers", "full_name", "PERSON") in found and ("payments", "card", "CREDIT_CARD") in found
    assert ("payments", "handle", "IN_UPI_ID") in found and not any(k[1] in ("notes", "payment_id") for k in found)


def test_profile_of_a_wide_table(spark):
    """Each pattern stands in the plan once however many columns there are; columns of nulls, of blanks and of an empty table have zeros."""
    wide = spark.range(40).selectExpr(*(f"concat('m{c}.', id, '@x{c}.example') AS c{c}" for c in range(200)), "cast(null AS string) AS none", "'' AS blank", "id", "'a' AS `odd.name`")
    profile = cols.value_profile(wide, "wide", recognisers())
    rows = {(r["column"], r["pii_type"]): (r["non_null"], r["hits"]) for r in profile.collect()}
    kinds = {r.entity for r in recognisers()}
    assert len(rows) == 203 * len(kinds)
    assert all(rows[f"c{c}", "EMAIL_ADDRESS"] == (40, 40) for c in range(200))
    assert all(rows["none", k] == (0, 0) and rows["blank", k] == (40, 0) and rows["odd.name", k] == (40, 0) for k in kinds)

    def patterns(frame):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("RLIKE") + plan.count("regexp_extract_all")

    assert patterns(profile) == patterns(cols.value_profile(wide.select("c0"), "wide", recognisers()))
    assert {(r["non_null"], r["hits"]) for r in cols.value_profile(wide.limit(0), "wide", recognisers()).collect()} == {(0, 0)}
    assert cols.value_profile(wide.select("id"), "wide", recognisers()).count() == 0


def test_samples_in_byte_order(spark):
    values = ["b", "é", "\U0001f600", "a", None, "", "a", "\ue000", "Z", *("x" * (k % 50) for k in range(500))]
    table = spark.createDataFrame([(v, k % 3 == 0 and v or None) for k, v in enumerate(values)], "v string, w string").repartition(4)
    options = cols.SampleOptions(enabled=True, limit_per_column=1000, max_value_length=200, exclude_null=False, exclude_empty_strings=False)
    got = cols.column_samples(table, ["v", "w"], options).orderBy("column", "rank").collect()
    for c, given in (("v", values), ("w", [v for k, v in enumerate(values) if k % 3 == 0 and v] + [None])):
        want = sorted(set(given), key=lambda v: (v is not None, (v or "").encode()))
        assert [r["value"] for r in got if r["column"] == c] == [v or "" for v in want]


def test_samples(spark, crm):
    table = spark.createDataFrame([(v,) for v in ["b ", "b ", "", None, "a" * 20, "c", "d", " "]], "v string")
    take = lambda **kw: [r["value"] for r in cols.column_samples(table, ["v"], cols.SampleOptions(**kw)).orderBy("rank").collect()]
    assert take(limit_per_column=4, max_value_length=8) == ["aaaaaaaa...", "b"]  # the limit counts the blanks too
    assert take(limit_per_column=9) == ["a" * 20, "b", "c", "d"]
    assert take(limit_per_column=9, distinct=False).count("b") == 2
    assert len(take(limit_per_column=9, exclude_empty_strings=False)) == 6
    lists = cols.sample_lists(cols.column_samples(crm["sales.customers"], ["email", "scan"], cols.SampleOptions())).collect()
    got = {r["column"]: r["sample_values"] for r in lists}
    assert got == {"email": ["asha@example.in", "john@example.org", "ravi@example.in"], "scan": ["ok", "� blob"]}


def test_sample_limit_is_applied_before_the_shuffle(spark, crm):
    plan = cols.column_samples(crm["sales.customers"], ["email"], cols.SampleOptions())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    lines = plan.splitlines()
    below = [i for i, line in enumerate(lines) if "MapInArrow" in line]
    assert below and max(i for i, line in enumerate(lines) if "Exchange" in line) < below[0]


def test_samples_over_many_partitions(spark):
    table = spark.range(0, 5000, 1, 7).selectExpr("cast(id % 900 as string) AS a", "CASE WHEN id % 3 > 0 THEN concat('é', id % 40) END AS b")
    for kw in ({}, {"exclude_null": False}):
        got = cols.column_samples(table, ["a", "b"], cols.SampleOptions(limit_per_column=12, exclude_empty_strings=False, **kw)).collect()
        for c in ("a", "b"):
            values = [r[c] for r in table.select(c).distinct().collect() if r[c] is not None or kw]
            assert [r["value"] for r in sorted(got, key=lambda r: r["rank"]) if r["column"] == c] == ["" if v is None else v for v in sorted(values, key=lambda v: (v is not None, v or ""))[:12]]


def test_sample_options():
    options = cols.SampleOptions.from_config({"limit": 5000, "max_chars": 2}, {"distinct": "no"})
    assert (options.limit_per_column, options.max_value_length, options.distinct) == (1000, 8, False)
    assert not cols.SampleOptions.from_config({"limit": 3}, False).enabled
    assert cols.SampleOptions.from_config({"limit_per_column": "many"}).limit_per_column == 5


def test_selection(spark):
    names = spark.createDataFrame([("Main",), ("logs",), ("tmp",)], "name string")
    pick = lambda **kw: [r["name"] for r in tb.select_databases(names, **kw).orderBy("name").collect()]
    assert pick() == ["Main", "logs", "tmp"] and pick(include=["MAIN", "tmp"], exclude=["Tmp "]) == ["Main"]
    assert tb.database_targets(["a", "B"], "", "", True, ["b"]) == (["a"], None)
    assert tb.database_targets([], "", "shop", True, []) == (["shop"], None)
    assert tb.database_targets([], "", "", True, []) == (None, None)
    assert tb.database_targets([], "", "", False, [])[1] == "No database specified and include_all_databases is false."
    catalog = spark.createDataFrame([("s", "T1"), ("", "t1"), ("s", "t2"), (None, "t3")], "schema string, table string")
    kept = lambda **kw: sorted((r["schema"] or "", r["table"]) for r in tb.filter_tables(catalog, tb.TableFilter(**kw)).collect())
    assert kept(include=("t1",)) == [("", "t1"), ("s", "T1")] and kept(include=("S.T1",)) == [("s", "T1")]
    assert kept(exclude=("t1",)) == [("", "t3"), ("s", "t2")] and kept(exclude_schemas=("S",)) == [("", "t1"), ("", "t3")]
    lists = [spark.createDataFrame([(n,) for n in v], "name string") for v in (["t1", "S.t2"], ["s.T1"])]
    framed = tb.filter_tables_by_frame(catalog, *lists).collect()
    assert sorted((r["schema"], r["table"]) for r in framed) == [("", "t1"), ("s", "t2")]
    assert [r["name"] for r in tb.catalog_databases(spark).collect()] == ["default"]
    with pytest.raises(ValueError):
        tb.jdbc_databases(spark, "dynamodb", "x")


def test_databases(spark, crm):
    settings = {
        "sample_values": {"limit": 2},
        "connections": [
            {"name": "crm", "url": "postgresql://u:p@db.example.com/main", "exclude_tables": ["payments"], "queries": [{}]},
            {"name": "off", "enabled": False, "url": "x"},
            {"url": ""},
            {"name": "bare", "url": "mysql://h/", "include_all_databases": False},
            {"name": "none", "url": "mysql://h/d", "include_all_tables": False},
            {"name": "undetected", "url": "mysql://h/d", "detector": {"enabled": False}},
            {"name": "two", "url": "mysql://h/", "databases": ["a", "b"], "tables": ["nothing"]},
            {"name": "broken", "url": "mysql://h/boom"},
        ],
    }

    def read(connection, database):
        if database == "boom":
            raise RuntimeError("no route")
        return crm

    records = read_databases(spark, settings, recognisers(), read)
    rows = {r["source_path"]: r for r in records.collect()}
    assert rows["db://database_3"]["reason"].startswith("Missing connection URL")
    assert rows["db://bare"]["record_type"] == "error" and rows["db://none"]["record_type"] == "skip"
    assert "disabled" in rows["db://undetected"]["reason"] and rows["db://crm/queries"]["record_type"] == "skip"
    assert rows["db://two:a"]["reason"] == rows["db://two:b"]["reason"] == "No pii columns detected."
    assert rows["db://broken"]["record_type"] == "error" and "no route" in rows["db://broken"]["reason"]
    email = rows["db://crm/table:sales.customers/column:email"]["metadata"]
    assert (email["connection_endpoint"], email["connection_type"], email["database"]) == ("db.example.com/main", "postgresql", "main")
    assert email["sample_values"] == ["asha@example.in", "john@example.org"] and email["sample_value_preview"] == "asha@example.in"
    assert not any("payments" in p for p in rows)

    findings = database_findings(records)
    text_rows = text_records(crm["payments"], "payments", "payment_id", "handle")
    result = scan_records(union_all([text_rows, records]), ScanSpec(rules_for("default")), findings)
    by_path = {r["file_path"]: r for r in result.sources.collect()}
    assert by_path["db://crm/table:sales.customers/column:pan"]["findings_count"] == 1
    one = findings.filter("file_path = 'db://crm/table:sales.customers/column:pan'").first()
    assert (one["entity_type"], one["text"], one["start"], one["end"], one["score"]) == ("IN_PAN", "sales.customers.pan", 0, 19, 1.0)
    stats = result.stats.first()
    assert stats["sources_failed"] == 3 and stats["total_findings"] == result.findings.count()
    empty = read_databases(spark, {"connections": []}, [], read).collect()
    assert empty[0]["reason"] == "Database plugin enabled but no connections configured."


def test_all_sources(spark, tree, crm):
    def config(url):
        return {
            "scan": {"input_paths": [f"{tree}/in/profile.txt"]},
            "sources": {
                "enabled_sources": ["filesystem", "database"],
                "database": {"enabled": True, "connections": [{"name": "crm", "url": url, "include_schemas": ["sales"]}]},
            },
        }

    def read(connection, database):
        if database == "boom":
            raise RuntimeError("down")
        return crm

    result = scan_all(spark, spec_from(config("mysql://u:p@h/main")), read)
    plugins = {r["plugin"]: r for r in result.plugins().collect()}
    assert plugins["filesystem"]["sources_scanned"] == 1 and plugins["filesystem"]["findings"] >= 8
    assert plugins["database"]["sources_scanned"] == 5 and plugins["database"]["findings"] >= 5
    run = result.records.filter("plugin_name = 'database'").select("metadata.run.*").first()
    assert (run["table_count"], run["pii_column_count"], run["source_type"]) == (1, 5, "mysql")
    failed = scan_all(spark, spec_from(config("mysql://u:p@h/boom")), read).sources.filter("status = 'failed'").collect()
    assert len(failed) == 1 and "down" in failed[0]["error"]


def test_catalog_reader(spark):
    spark.sql("CREATE TABLE IF NOT EXISTS default.people USING parquet AS SELECT 'a@b.com' AS email")
    tables = catalog_tables(spark)({"url": "catalog:default"}, "default")
    assert "people" in tables and tables["people"].columns == ["email"]
    spark.sql("DROP TABLE default.people")
    with pytest.raises(ValueError):  # the catalog's tables are not those of another URL
        catalog_tables(spark)({"url": "mysql://h/default"}, "default")


def test_detector_switch_for_all_connections(spark, crm):
    connections = [{"name": "a", "url": "mysql://h/d"}, {"name": "b", "url": "mysql://h/d", "detector": {"enabled": True}}]
    rows = read_databases(spark, {"detector": {"enabled": False}, "connections": connections}, recognisers(), lambda *_: crm).collect()
    assert [r["record_type"] for r in rows if r["source_path"] == "db://a"] == ["skip"]
    assert any(r["source_path"].startswith("db://b/table:") for r in rows)


def test_totals_with_repeated_ids(spark):
    table = spark.createDataFrame([(1, "a@b.com"), (1, "c@d.org")], "id long, text string")
    result = scan_records(text_records(table, "t", "id", "text"), ScanSpec(rules_for("default")))
    assert result.findings.count() == 2 and result.stats.first()["total_findings"] == 2
    assert [(r["sources_scanned"], r["findings"]) for r in result.plugins().collect() if r["plugin"] == "table"] == [(2, 2)]


def test_detector_output(spark):
    rows = spark.createDataFrame(
        [(" S ", "T", "", "C1", "EMAIL"), ("", "", "T2", "C1", None), ("x", "", "", "C", "E"), ("s", "t", "", "", "E")],
        "schema string, table_name string, table string, column string, detector string",
    )
    got = {tuple(r) for r in cols.normalise_detections(rows).collect()}
    assert got == {("s", "t", "c1", "EMAIL"), ("", "t2", "c1", "")}
    records = cols.column_records(cols.detection_catalog(cols.normalise_detections(rows)), "c")
    found = {(r["text"], r["entity_type"]) for r in cols.column_findings(records).collect()}
    assert found == {("s.t.c1", "EMAIL"), ("t2.c1", "PII")}


def test_stream(spark, tmp_path):
    spec = ScanSpec(rules_for("default"))
    table = spark.createDataFrame([(1, PROFILE), (2, HARMLESS), (3, EXPORT)], "id long, text string")
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    query = stream_findings(text_records(stream, "t", "id", "text"), spec, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert query.awaitTermination(120)
    batch = scan_records(text_records(table, "t", "id", "text"), spec).findings
    assert spark.read.parquet(str(tmp_path / "out")).count() == batch.count() > 10


def test_no_column_holds_a_masked_path(spark, tree):
    for mode in ("basename", "hash", "redacted"):
        out = FileOutput(mask_mode=mode, base_dirs=(tree,), report_path=f"{tree}/out/output.json")
        rows = read_files(spark, [Location("a", (f"{tree}/in",))], out).select("source_id", "source_path", "metadata").collect()
        assert rows and not any(tree in repr(r) for r in rows)


def test_hidden_names_are_read(spark, tmp_path):
    names = ("a.txt", "_b.txt", ".c.txt", "_priv/d.txt", ".cfg/e.txt", "_priv/deep/f.txt", "part_=1/_g=1.txt")
    for name in (*names, ".git/x.txt", "_priv/node_modules/y.txt", "_z.pyc"):
        put(str(tmp_path), f"in/{name}", PROFILE)
    put(str(tmp_path), "in/_big.txt", "x" * 3_000_000)
    root = str(tmp_path / "in")
    out = FileOutput(mask_mode="relative", base_dirs=(root,))
    rows = read_files(spark, [Location("a", (root,), max_file_size_mb=1)], out).collect()
    assert sorted(r["source_path"] for r in rows) == sorted([*names, "_big.txt"])
    assert {r["source_path"]: r["record_type"] for r in rows}["_big.txt"] == "skip"
    assert all(r["text"] == PROFILE for r in rows if r["record_type"] == "source")
    flat = read_files(spark, [Location("a", (root,), recursive=False)], out).collect()
    assert sorted(r["source_path"] for r in flat) == [".c.txt", "_b.txt", "_big.txt", "a.txt"]
    for one in (f"{root}/_b.txt", f"file://{root}/a.txt", f"{root}/_priv/d.txt", f"{root}/.cfg"):
        assert read_files(spark, [Location("a", (one,))], out).count() == 1


def test_datasets_below_the_report_path_are_not_read(spark, tmp_path):
    put(str(tmp_path), "in/a.txt", PROFILE)
    put(str(tmp_path), "in/report/findings/part-0.json", PROFILE)
    out = FileOutput(report_path=str(tmp_path / "in/report"))
    assert read_files(spark, [Location("a", (str(tmp_path / "in"),))], out).count() == 1


@pytest.fixture(scope="module")
def many_orders(spark, tmp_path_factory):
    """One file and one split with more rows than the cores take at SLIM_ROWS each."""
    place = str(tmp_path_factory.mktemp("orders"))
    rows = (spark.sparkContext.defaultParallelism + 2) * SLIM_ROWS - 1
    table = spark.range(rows).selectExpr("id AS o_orderkey", "'F' AS o_orderstatus", "'1-URGENT' AS o_orderpriority", "timestamp'1996-01-02' AS o_orderdate")
    table.coalesce(1).write.parquet(f"{place}/orders.parquet")
    return place


@pytest.mark.parametrize("name", ["scan_order_text", "dedup_spans_best_score", "same_span_winner", "same_span_winner_in_row", "scan_order_text_prod"])
def test_order_scans_have_a_task_per_slim_rows(spark, many_orders, name):
    assert QUERIES[name](spark, many_orders).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism + 2


def test_slim_rows_are_dealt_whole_and_evenly(spark, many_orders):
    cores = spark.sparkContext.defaultParallelism
    orders = spark.read.parquet(f"{many_orders}/orders.parquet")
    dealt = spread_slim(orders, "o_orderkey")
    sizes = [r["n"] for r in dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == cores + 2 and sum(sizes) == (cores + 2) * SLIM_ROWS - 1 and max(sizes) < 1.1 * SLIM_ROWS
    assert dealt.exceptAll(orders).count() == 0
    # few rows go to all cores; enough splits stay as they are
    assert spread_slim(orders.limit(10), "o_orderkey").rdd.getNumPartitions() == cores
    assert spread_slim(spark.range(0, 10, 1, cores + 3), "id").rdd.getNumPartitions() == cores + 3
    assert spread_slim(orders.filter("false"), "o_orderkey").count() == 0


@pytest.mark.parametrize("name", ["dedup_spans_best_score", "same_span_winner"])
def test_span_windows_use_the_dealing_of_the_orders(spark, many_orders, name, capsys):
    QUERIES[name](spark, many_orders).explain()
    plan = capsys.readouterr().out
    assert "Window " in plan and plan.count("Exchange ") == 1


BATCH_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_docx_workers_hold_small_batches(spark, monkeypatch):
    spark.conf.unset(BATCH_BOUND)
    extract = docx.extract_documents

    def measured(batches):
        for batch in batches:
            size = sum(map(len, batch["content"]))
            for out in extract(iter([batch])):
                yield out.assign(size=size)

    monkeypatch.setattr(docx, "extract_documents", measured)
    content = docx_bytes("Customer PAN ABCDE1234F\n" * 400)
    files = spark.createDataFrame(pd.DataFrame({"id": range(1500), "content": [content] * 1500})).coalesce(1)
    rows = docx.extracted(files, "id long, text string, error string, size long").collect()
    assert sorted(r["id"] for r in rows) == list(range(1500)) and all(r["text"] == "Customer PAN ABCDE1234F\n" * 400 for r in rows)
    assert len(content) * 1500 > 10 * PYTHON_BATCH and max(r["size"] for r in rows) < 1.5 * PYTHON_BATCH


def test_docx_query_bounds_its_batches(spark):
    spark.conf.unset(BATCH_BOUND)
    QUERIES["docx_extract"](spark, "/root/testdata/sf0.001")
    assert spark.conf.get(BATCH_BOUND) == str(PYTHON_BATCH)


@pytest.mark.parametrize(("given", "kept"), [("64m", False), ("67108864b", False), ("5MB", False), ("4m", True), ("512k", True), ("1000", True)])
def test_a_smaller_batch_bound_is_kept(spark, given, kept):
    spark.conf.set(BATCH_BOUND, given)
    small_batches(spark.range(1))
    assert spark.conf.get(BATCH_BOUND) == (given if kept else str(PYTHON_BATCH))
    spark.conf.unset(BATCH_BOUND)
