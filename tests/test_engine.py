import time

import pytest
from pyspark.sql import functions as F

from larkspur.cli import shell
from larkspur.functions.values import cut, cut_column, render
from larkspur.plans.dialect import DialectError
from larkspur.plans.planner import join_condition
from larkspur.session import Engine

SHIPS = "CREATE TABLE SHIPS (HULL DECIMAL, NAME VARCHAR(64), TONS DECIMAL, EXPIRES_AT DECIMAL); INSERT INTO SHIPS VALUES (11,'Heron',310,1900000000),(4,'Tern',95,1900000000),(27,'Skua',1480,1900000000),(8,'Plover',620,1900000000)"
NOW = 1_700_000_000


@pytest.fixture(params=[False, True], ids=["memory", "durable"])
def engine(spark, request, tmp_path):
    return Engine(spark, f"file://{tmp_path}" if request.param else None)


def rows(engine, sql, now=NOW):
    return [" | ".join(r) for r in engine.exec(sql, now=now)[-1].rows]


def refused(engine, sql):
    with pytest.raises(DialectError) as e:
        engine.exec(sql, now=NOW)
    return str(e.value)


def test_statements_and_refusals(engine):
    engine.exec(SHIPS)
    assert rows(engine, "SELECT COUNT(*) FROM SHIPS WHERE TONS >= 310") == ["3"]
    assert rows(engine, "SELECT TONS, NAME FROM ships WHERE HULL = 4") == ["95 | Tern"]
    assert rows(engine, "SELECT * FROM SHIPS") == ["11 | Heron | 310 | 1900000000", "4 | Tern | 95 | 1900000000", "27 | Skua | 1480 | 1900000000", "8 | Plover | 620 | 1900000000"]
    assert rows(engine, "SELECT HULL FROM SHIPS WHERE TONS > 9000 OR NAME = 'Skua' AND TONS < 1481") == ["27"]
    for again in ("(5,'x',1,1),(27,'y',1,1)", "(5,'x',1,1),(5,'y',1,1)"):
        assert refused(engine, f"INSERT INTO SHIPS VALUES {again}") == "duplicate primary key"
    engine.exec("CREATE TABLE CALLS (NO INT, SHIP INT, CRATES INT); INSERT INTO CALLS VALUES (1,27,40),(2,8,3),(3,27,7),(4,99,5)")
    assert rows(engine, "SELECT s.NAME AS ship, c.CRATES FROM SHIPS s INNER JOIN CALLS c ON c.SHIP = s.HULL WHERE c.CRATES < 30") == ["Skua | 7", "Plover | 3"]
    assert engine.exec("SELECT s.NAME AS ship FROM SHIPS s INNER JOIN CALLS c ON c.SHIP = s.HULL")[0].columns == ("ship",)
    for sql, error in (
        ("SELECT x FROM SHIPS", "unknown column: x"), ("SELECT HULL FROM SHIPS WHERE x = 1", "unknown column: x"), ("SELECT * FROM missing", "no such table: missing"), ("CREATE TABLE ships (a INT)", "table already exists"),
        ("SELECT COUNT(*) FROM SHIPS INNER JOIN CALLS ON HULL = SHIP", "COUNT(*) with JOIN is not supported"), ("SELECT * FROM SHIPS INNER JOIN CALLS ON HULL = nope", "unknown join column"),
        ("SELECT * FROM SHIPS INNER JOIN CALLS ON HULL = SHIP WHERE nope = 1", "unknown column in WHERE: nope"), ("INSERT INTO CALLS VALUES (1)", "column count mismatch"), ("INSERT INTO CALLS VALUES (1, 'a', 2)", "type mismatch: expected integer value"),
        ("SELECT HULL FROM SHIPS UNION SELECT NO FROM CALLS", "unexpected tokens at end of query"), ("SELECT HULL, RANK() FROM SHIPS", "expected FROM"), ("SELECT * FROM (SELECT * FROM SHIPS)", "expected table name after FROM"), ("EXPLAIN SELECT * FROM SHIPS", "unsupported SQL statement"), ("BEGIN", "unsupported SQL statement"),
    ):
        assert refused(engine, sql) == error
    engine.exec("DROP TABLE CALLS; DROP TABLE IF EXISTS CALLS")
    assert refused(engine, "DROP TABLE CALLS") == "no such table: CALLS"


def test_values(engine):
    engine.exec("CREATE TABLE T (ID INT, N VARCHAR(2), F FLOAT, EXPIRES_AT INT); INSERT INTO T VALUES (NULL, NULL, NULL, NULL), (1, 'abcd', 1, 100), (2, 'héllo', 98.50, 101), (3, '', 2.25, 99)")
    assert rows(engine, "SELECT ID, N, F FROM T", now=100) == ["1 | ab | 1", "2 | h | 98.5"]
    assert rows(engine, "SELECT COUNT(*) AS c FROM T WHERE N = 1 OR ID = NULL OR F = 98.5", now=100) == ["1"]
    assert refused(engine, "INSERT INTO T VALUES (3, 'x', 1.0, 500)") == "duplicate primary key"
    assert engine.maintain(now=100) == {"T": 2}
    engine.exec("INSERT INTO T VALUES (3, 'x', 1.0, 500)")
    assert rows(engine, "SELECT ID FROM T", now=0) == ["1", "2", "3"]
    engine.exec("CREATE TABLE B (ID INT); INSERT INTO B VALUES (9007199254740992), (9007199254740993)")
    assert rows(engine, "SELECT ID FROM B WHERE ID = 9007199254740993") == ["9007199254740993"]
    assert render(75.0) == "75" and render(1e20) == "1e+20" and cut("héllo", 2) == "h"


def test_bulk_and_durability(spark, tmp_path):
    root = f"file://{tmp_path}"
    engine = Engine(spark, root)
    assert refused(engine, "BULK_INSERT BIG_USERS 1 10") == "no such table: big_users"
    engine.exec("CREATE TABLE BIG_USERS (ID DECIMAL, NAME VARCHAR(64), EMAIL VARCHAR(64), BALANCE DECIMAL, EXPIRES_AT DECIMAL); BULK_INSERT BIG_USERS 1 20000")
    assert rows(engine, "SELECT COUNT(*) FROM BIG_USERS") == ["20000"]
    assert rows(engine, "SELECT COUNT(*) FROM BIG_USERS WHERE ID >= 5000 AND ID <= 15000") == ["10001"]
    assert refused(engine, "BULK_INSERT BIG_USERS 20000 5") == "duplicate primary key"
    engine.exec("INSERT INTO BIG_USERS VALUES (30000, 'a', 'b', 12.9, 1893456000)")
    spark.range(5).write.parquet(f"{tmp_path}/big_users/left-over")  # a statement that never committed
    again = Engine(spark, root)
    assert rows(again, "SELECT COUNT(*) FROM BIG_USERS") == ["20001"]
    assert rows(again, "SELECT BALANCE FROM BIG_USERS WHERE ID = 30000") == ["12"]
    again.catalog.compact(again.catalog.get("big_users"))
    assert len(again.catalog.get("big_users").batches) == 1
    assert rows(Engine(spark, root), "SELECT NAME FROM BIG_USERS WHERE ID <= 2") == ["user1", "user2"]


def test_cache_callback_and_shell(spark):
    engine = Engine(spark, cache_size=2)
    engine.exec("CREATE TABLE E (ID INT PRIMARY KEY, N TEXT); INSERT INTO E VALUES (1,'a'),(2,'b')")
    first = engine.exec("SELECT * FROM E")[0]
    assert engine.exec("select  * from e")[0] is first
    engine.exec("INSERT INTO E VALUES (3,'c')")
    assert len(engine.exec("SELECT * FROM E")[0].rows) == 3 and len(engine.cache) <= 2
    seen = []
    engine.exec("SELECT ID FROM E", callback=lambda c, r: seen.append(r) or len(seen) == 2)
    assert seen == [("1",), ("2",)]
    out = []
    shell(engine, ["SELECT ID\n", "FROM E WHERE N = 'c';\n", "SELEC;\n", "exit\n"], out.append)
    assert out == ["ID = 3", "OK", "ERROR: unsupported SQL statement"]
    assert engine.sql_extended("SELECT max(ID) AS m FROM {e}").first()["m"] == 3


def test_streaming_triples(spark, tmp_path):
    from larkspur.streaming.triples import current, ingest

    (tmp_path / "in").mkdir()
    for i, text in enumerate(("1,2,3\n4,5,6,4,7,8", "1,9,9\n7,7")):
        (tmp_path / "in" / f"{i}.csv").write_text(text)
        ingest(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert sorted((int(r.key), r.val1, r.val2) for r in current(spark, f"{tmp_path}/out").collect()) == [(1, 9, 9), (4, 7, 8)]


def test_streaming_merges_batches_and_keeps_the_order_of_arrival(spark, tmp_path, monkeypatch):
    from larkspur.streaming import triples

    monkeypatch.setattr(triples, "SNAPSHOT_EVERY", 2)
    (tmp_path / "in").mkdir()
    for i in range(7):
        (tmp_path / "in" / f"{i}.csv").write_text(f"1,{i},0\n{i + 10},1\n,1\n2,{i}\n,{i},2,{i},{i + 1}\n5,x,5\n6,6,6\n")
        triples.ingest(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = {int(r.key): (r.val1, r.val2) for r in triples.current(spark, f"{tmp_path}/out").collect()}
    assert got == {1: (6, 0), 2: (6, 7)} | {i + 10: (1, 1) for i in range(7)}
    assert len(list((tmp_path / "out" / "snapshots").iterdir())) <= 3 and len(list((tmp_path / "out" / "batches").iterdir())) <= 3


def test_triples_of_split_files(spark):
    """Lines in many blocks give what the whole text gives, wherever lines cut triples."""
    import random

    from larkspur.streaming.triples import file_triples

    r = random.Random(5)
    lines, want = [], []
    for file in ("a", "b", "c"):
        fields, stop = [], False
        for k in range(60):
            part = [str(r.choice((r.randrange(10), 10**30 + r.randrange(99), (1 << 64) + 7))) for _ in range(r.randrange(5))]
            bad = file == "b" and k == 41
            lines.append((file, k // 7, k, ",".join(part) + ("," * (k % 3)) + ("z,1,1,1" if bad else "")))
            fields += [] if stop else part
            stop |= bad
        want += [(int(fields[i]) % (1 << 64), int(fields[i + 1]) % (1 << 32), int(fields[i + 2]) % (1 << 32)) for i in range(0, len(fields) // 3 * 3, 3)]
    got = file_triples(spark.createDataFrame(lines, "file string, block long, line long, value string").repartition(6))
    assert [(int(x.key), x.val1, x.val2) for x in got.orderBy("place").collect()] == want


def test_readers_keep_what_they_started_with(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}")
    engine.exec("CREATE TABLE T (ID INT, EXPIRES_AT INT); INSERT INTO T VALUES (1, 100), (2, 300); INSERT INTO T VALUES (3, 100)")
    before = engine.sql("SELECT ID FROM T", now=50)
    assert engine.maintain(now=200) == {"T": 2}
    engine.catalog.compact(engine.catalog.get("T"))
    engine.exec("INSERT INTO T VALUES (9, 500)")
    after = engine.sql("SELECT ID FROM T", now=50)
    engine.exec("DROP TABLE T")
    assert sorted(r.ID for r in before.collect()) == [1, 2, 3] and sorted(r.ID for r in after.collect()) == [2, 9]
    spark.range(3).write.parquet(f"{tmp_path}/t/left-over")
    assert engine.catalog.vacuum(3600) == 0
    assert engine.catalog.vacuum(0) == 5 and list((tmp_path / "t").iterdir()) == []
    assert Engine(spark, f"file://{tmp_path}").catalog.tables == {}


def test_vacuum_after_replay_leaves_what_is_used(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}")
    engine.exec("CREATE TABLE T (ID INT); INSERT INTO T VALUES (1); INSERT INTO T VALUES (2)")
    engine.catalog.compact(engine.catalog.get("T"))
    again = Engine(spark, f"file://{tmp_path}", retention=0)
    again.maintain()
    assert rows(again, "SELECT ID FROM T") == ["1", "2"] and len(list((tmp_path / "t").iterdir())) == 1


def test_order_of_insertion_over_many_partitions(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}")
    engine.exec("CREATE TABLE T (ID INT PRIMARY KEY, N TEXT)")
    engine.catalog.insert_frame("T", spark.range(0, 2000, 1, 1000).selectExpr("2000 - id AS id", "'a'"))
    engine.exec("INSERT INTO T VALUES (-5, 'last'), (5000, 'very last')")
    want = [str(2000 - i) for i in range(2000)] + ["-5", "5000"]
    assert rows(engine, "SELECT ID FROM T") == want
    engine.catalog.compact(engine.catalog.get("T"))
    assert rows(Engine(spark, f"file://{tmp_path}"), "SELECT ID FROM T") == want


def test_callback_stops_before_later_batches_are_read(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}")
    engine.exec("CREATE TABLE T (ID INT)")
    for i in range(8):
        engine.exec(f"INSERT INTO T VALUES ({i})")
    for batch in engine.catalog.get("T").batches[3:]:  # whoever reads them fails
        for f in (tmp_path / batch).glob("*.parquet"):
            f.write_bytes(b"broken")
        for f in (tmp_path / batch).glob(".*.crc"):
            f.unlink()
    seen = []
    assert engine.exec("SELECT ID FROM T", lambda c, r: seen.append(r[0]) or len(seen) == 3)[0].rows == ()
    assert seen == ["0", "1", "2"] and not engine.cache
    with pytest.raises(Exception, match="(?i)parquet"):
        engine.exec("SELECT ID FROM T", lambda c, r: None)


def test_cache_is_bounded_by_bytes(spark):
    engine = Engine(spark, cache_bytes=4000)
    engine.exec("CREATE TABLE T (ID INT, N VARCHAR(2000)); INSERT INTO T VALUES (1, 'x'), (2, '" + "y" * 1500 + "')")
    engine.exec("SELECT N FROM T")
    assert not engine.cache  # too large to be kept
    for i in range(60):
        engine.exec(f"SELECT ID FROM T WHERE ID > {-i}")
    assert 0 < sum(n for _, n in engine.cache.values()) <= 4000 and len(engine.cache) < 60


def test_insert_reads_only_what_its_keys_may_be_in(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}")
    engine.exec("CREATE TABLE T (N TEXT, ID INT PRIMARY KEY); INSERT INTO T VALUES ('a', 1), ('b', 2)")
    table = engine.catalog.get("T")
    plan = engine.catalog.stored(table, [2, 7])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ID,2)" in plan and "LessThanOrEqual(ID,7)" in plan and "In(ID, [2,7])" in plan and "ReadSchema: struct<ID:bigint>" in plan
    assert engine.catalog.stored(table, [5, 7]) is None  # the log tells what keys a batch has
    engine.exec("INSERT INTO T VALUES ('c', 7)")
    assert {f.split("/")[-2] for f in engine.catalog.stored(table, [6, 9]).inputFiles()} == {table.batches[1].split("/")[1]}
    assert [Engine(spark, f"file://{tmp_path}").catalog.get("T").zones, engine.catalog.get("T").zones] == [[[1, 2], [7, 7]]] * 2
    assert refused(engine, "INSERT INTO T VALUES ('d', 8), ('e', 7)") == "duplicate primary key"
    engine.catalog.compact(engine.catalog.get("T"))
    assert refused(engine, "INSERT INTO T VALUES ('d', 2)") == "duplicate primary key"


def test_insert_frame_cuts_and_checks(spark, tmp_path):
    texts = ["abc", "añb", "日本", "", None, "a\0b", "🙂🙂", "éé"]
    for size in range(1, 9):
        got = spark.createDataFrame([(t,) for t in texts], "t string").select(cut_column(F.col("t"), size).alias("c")).collect()
        assert [r.c for r in got] == [None if t is None else cut(t, size) for t in texts]
    engine = Engine(spark, f"file://{tmp_path}")
    engine.exec("CREATE TABLE T (ID INT PRIMARY KEY, N VARCHAR(4), F FLOAT)")
    engine.catalog.insert_frame("T", spark.createDataFrame([(1, "日本", 2), (None, None, None)], "a int, b string, c int"))
    assert rows(engine, "SELECT * FROM T") == ["1 | 日 | 2", "0 |  | 0"]
    for bad, error in (([(1, "x", 2)], "duplicate primary key"), ([(7, "x", 2), (7, "y", 2)], "duplicate primary key"), ([("a", "x", 2)], "type mismatch: expected integer value")):
        with pytest.raises(DialectError, match=error):
            engine.catalog.insert_frame("T", spark.createDataFrame(bad, f"a {'string' if bad[0][0] == 'a' else 'int'}, b string, c int"))
    assert rows(engine, "SELECT COUNT(*) FROM T") == ["2"] and len(list((tmp_path / "t").iterdir())) == 1


def test_doubles_join_texts_as_they_are_rendered(spark):
    values = [1.0, 0.1, 1e20, -2.5, 1e-7, 123456789.123456789, float("nan")]
    left = spark.createDataFrame([(v,) for v in [*values, None]], "x double")
    right = spark.createDataFrame([(render(v),) for v in values], "t string")
    on = join_condition((left["x"], "float", "x"), (right["t"], "str", "t"))
    assert sorted(r.t for r in left.join(right, on).collect()) == sorted(render(v) for v in values if v == v)


def test_maintenance_in_the_background(spark):
    engine = Engine(spark)
    engine.exec("CREATE TABLE T (ID INT, EXPIRES_AT INT); INSERT INTO T VALUES (1, 100)")
    stop = engine.maintain_every(0.2)
    end = time.time() + 20
    before = engine.catalog.get("T").version
    while engine.catalog.get("T").version == before and time.time() < end:
        time.sleep(0.1)
    stop()
    assert rows(engine, "SELECT COUNT(*) FROM T", now=0) == ["0"]


def test_plans(spark):
    data = "/root/testdata/sf0.001"
    engine = Engine.over(spark, data, "orders", "customer")
    plan = engine.sql("SELECT o_orderkey FROM orders WHERE o_orderkey = 42")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderkey,42)" in plan and "ReadSchema: struct<o_orderkey:bigint>" in plan
    plan = engine.sql("SELECT c_name FROM customer INNER JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 5")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "GreaterThan(o_totalprice,5.0)" in plan


def test_remote_client(spark):
    from larkspur.wire import Server, connect, encode_row

    assert encode_row(("a", "é"), ("x", "")) == b"ROW 2 1:a1:x2:\xc3\xa90:\n"
    with Server(Engine(spark)) as server, connect("127.0.0.1", server.port) as client, connect("127.0.0.1", server.port) as other:
        client.exec("CREATE TABLE T (ID INT PRIMARY KEY, N TEXT); INSERT INTO T VALUES (1, 'a;b'), (2, 'née'), (3, 'OK')")
        client.socket.sendall("SELECT N FROM T WHERE N = 'n".encode() + b"\xc3")
        time.sleep(0.2)
        client.socket.sendall(b"\xa9e';")
        assert list(client._rows()) == [(("N",), ("née",))]
        assert other.exec("SELECT * FROM T")[0].rows == (("1", "a;b"), ("2", "née"), ("3", "OK"))
        with pytest.raises(DialectError, match="duplicate primary key"):
            other.exec("INSERT INTO T VALUES (3, 'x')")
        seen = []
        other.exec("SELECT ID FROM T; SELECT N FROM T", lambda c, r: seen.append(r[0]) or len(seen) == 2)
        assert seen == ["1", "2"] and client.exec("SELECT COUNT(*) AS c FROM T")[0].rows == (("3",),)
