"""Faults that showed on larger tables or in a session without this library's settings."""

import shutil

import duckdb
from pyspark.sql import functions as F

from tests.harness import compare, connect
from veilgauge.functions.bytes import address_chunk, address_key
from veilgauge.functions.net import add_link, link_id
from veilgauge.operators.posture import positioned
from veilgauge.plans import all_queries

SMALL = "/root/testdata/sf0.001"


def as_sql(spark, name, sf_dir=SMALL):
    queries, oracles = all_queries()
    return compare(queries[name](spark, sf_dir), oracles[name], connect(sf_dir))


def with_rows(tmp_path, table, sql):
    """The smallest tables with `table` replaced by what `sql` says of it."""
    shutil.copytree(SMALL, tmp_path / "sf")
    target = tmp_path / "sf" / f"{table}.parquet"
    target.chmod(0o644)
    target.unlink()
    duckdb.sql(f"COPY ({sql.format(table=f'{SMALL}/{table}.parquet')}) TO '{target}' (FORMAT parquet)")
    return str(tmp_path / "sf")


def test_recent_events_with_the_default_state_store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        assert as_sql(spark, "st_recent_buffer") is None
    finally:
        spark.conf.set(key, before)


def test_links_of_quads_beyond_255(spark, tmp_path):
    sf = with_rows(tmp_path, "orders", "SELECT * REPLACE ((o_custkey + 300000)::BIGINT AS o_custkey) FROM '{table}'")
    for name in ("first_per_link", "fn_link_id", "fn_pair_key"):
        assert as_sql(spark, name, sf) is None


def test_quads_of_one_value_have_one_link(spark):
    df = spark.createDataFrame([("10.1.300.5", "10.2.44.5"), ("10.2.44.5", "10.1.300.5")], "a string, b string")
    for linked in (add_link(df, F.col("a"), F.col("b")), df.select(link_id(F.col("a"), F.col("b")).alias("link"))):
        assert linked.select("link").distinct().count() == 1
    p = df.select(F.col("a").alias("addr"), F.lit("all").alias("net"), address_key(F.col("a")).alias("key"))
    assert sorted(r.pos for r in positioned(p, ["net"], [F.asc("key")], address_chunk(F.col("key"))).collect()) == [1, 2]


def test_leak_of_a_host_without_known_resolvers(spark, tmp_path):
    sf = with_rows(tmp_path, "supplier", "SELECT t.* REPLACE ((s_suppkey + i * 1000)::BIGINT AS s_suppkey) FROM '/root/testdata/sf0.1/supplier.parquet' t, range(2) r(i)")
    queries, _ = all_queries()
    assert as_sql(spark, "vpn_dns_leak", sf) is None
    assert queries["vpn_dns_leak"](spark, sf).where("connected AND dns_leak IS NULL").count() > 0


def test_findings_move_no_transforms(spark):
    """Session rules run where the session row lies: no exchange of the findings carries a proposal."""
    from veilgauge.operators import rules as RU
    from veilgauge.plans.session_queries import flow_volumes, messages, strong

    found = RU.audit(messages(spark, SMALL), flow_volumes(spark, SMALL), strong=strong(spark, SMALL))
    told = found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    moved = [part for part in told.split("\n\n") if ") Exchange" in part.split("\n")[0] and "Input" in part]
    assert moved and not [part for part in moved if "transforms#" in part or "proposals#" in part]


def test_reused_values_of_any_text(spark):
    """Values that are no lower-case hex are told apart too, and come back as they were."""
    from veilgauge.operators import rules as RU

    rows = [("c", f"s{i}", i, "a", "b", value, None) for value in ("ab", "AB", "abc", "é", "x" * 70) for i in (2 * len(value), 2 * len(value) + 1)]
    rows += [("c", "lone", 900, "a", "b", "cd", None), ("c", "lone", 901, "a", "b", "cd", None)]
    m = spark.createDataFrame(rows, "capture string, initiator_spi string, frame bigint, src string, dst string, nonce_digest string, ke_digest string")
    assert sorted(r.digest for r in RU.reuse_table(m).collect()) == sorted(["ab", "AB", "abc", "é", "x" * 70])


def test_documents_are_written_compressed(spark, tmp_path):
    from veilgauge.sources import sinks as SK

    f = spark.createDataFrame([("c", "IKE-001", "t", "high", "s", "d", "{}", False)], "capture string, rule_id string, title string, severity string, subject string, detail string, evidence string, inferred boolean")
    SK.write_report(str(tmp_path / "rep"), {"finding": f})
    assert list((tmp_path / "rep").rglob("*.json.gz")) and not list((tmp_path / "rep").rglob("*.json"))


def told(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


def test_sessions_form_where_their_messages_are_made(spark):
    """Only slim rows of orders move: no exchange follows the one that spreads them by session."""
    from veilgauge.plans.session_queries import sess

    plan = told(sess(spark, SMALL))
    assert plan.count("REPARTITION_BY_NUM") == 2 and "ENSURE_REQUIREMENTS" not in plan


def test_values_stay_where_they_are_while_reused_ones_are_found(spark, tmp_path):
    """Of a table too large to be broadcast by its estimate, neither values nor messages move to meet the reused hashes."""
    from veilgauge.operators import rules as RU
    from veilgauge.plans.session_queries import messages

    plans, key = {}, "spark.sql.autoBroadcastJoinThreshold"

    def keep(name, df):
        plans[name] = told(df)
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    plain = sorted(RU.reuse_table(messages(spark, SMALL)).collect(), key=str)
    before = spark.conf.get(key)
    spark.conf.set(key, "4000")
    try:
        found = sorted(RU.reuse_table(messages(spark, SMALL), keep=keep).collect(), key=str)
    finally:
        spark.conf.set(key, before)
    assert found == plain and found
    assert "BroadcastHashJoin" in plans["reuse_values"] and "ENSURE_REQUIREMENTS" not in plans["reuse_values"]


def test_links_move_each_side_once(spark):
    from veilgauge.operators.posture import links
    from veilgauge.plans.session_queries import findings, flow_volumes, strong

    assert told(links(strong(spark, SMALL), flow_volumes(spark, SMALL), findings(spark, SMALL))).count("Exchange hashpartitioning") == 2


def test_links_of_unnamed_peers_and_of_both_directions(spark):
    from veilgauge.operators.posture import links

    peer = "capture string, peer_a string, peer_b string, classical_bits int, quantum_bits int, kex_family string, hybrid boolean"
    s = spark.createDataFrame([("c", "10.0.0.9", "10.0.0.10", 128, 0, "modp", False), ("c", "10.0.0.10", "10.0.0.9", 80, 0, "modp", False), ("c", "10.0.0.9", None, 80, 0, "unknown", False)], peer)
    f = spark.createDataFrame([("c", "10.0.0.10", "10.0.0.9"), ("c", "2001:db8::1", "host")], "capture string, src string, dst string")
    found = spark.createDataFrame([("c", "10.0.0.10 <-> 10.0.0.9", "high"), ("c", "10.0.0.10->10.0.0.9:0x1", "low"), ("c", "10.9.9.9 <-> 10.0.0.9", "high"), ("c", "none", "high")], "capture string, subject string, severity string")
    rows = {r.link: (r.sessions, r.tunnels, r.findings, r.high, r.low, r.classical_bits) for r in links(s, f, found).collect()}
    assert rows == {"10.0.0.9~10.0.0.10": (2, 1, 2, 1, 1, 80), "2001:db8::1~host": (0, 1, 0, 0, 0, None), None: (1, 0, 0, 0, 0, None)}


def test_lines_of_a_task_stay_together(spark, tmp_path):
    """A capture is written by several tasks, and the lines that one task read of it go to one file."""
    from veilgauge.sources import sinks as SK

    lines = spark.range(0, 4000, numPartitions=16).select(F.lit("c").alias("capture"), F.lit("x").alias("part"), F.col("id").cast("string").alias("body"))
    key = "spark.sql.adaptive.coalescePartitions.enabled"  # else so few lines end in one task
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        SK.by_capture(lines).write.partitionBy("capture").json(str(tmp_path / "dealt"))
    finally:
        spark.conf.set(key, before)
    seen = [{int(line.split('"body":"')[1].split('"')[0]) // 250 for line in f.read_text().splitlines()} for f in (tmp_path / "dealt").rglob("*.json")]
    assert 1 < len(seen) <= SK.FILES_PER_CAPTURE and sum(map(len, seen)) == 16 == len(set().union(*seen))
