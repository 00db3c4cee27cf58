"""Evidence, identity, strict reading and order, on small tables whose results are known."""

import hashlib
import hmac
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import scalar
from millrace.operators import checks, evaluation, evidence, grid, joins, profile, quantiles, sampling, series
from millrace.sources import files, strict


def test_summaries_keep_null_keys_and_infinities_close_them(spark):
    rows = [(None, 1.0), (None, 3.0), ("a", 2.0), ("a", float("inf")), ("b", 5.0)]
    table = spark.createDataFrame(rows, "g string, v double")
    said = {r["g"]: r for r in profile.summarise_closed(table, ["g"], F.col("v"), F.lit(True)).collect()}
    assert (said[None]["median"], said[None]["status"], said[None]["n"]) == (2.0, "valid", 2)
    assert (said["a"]["median"], said["a"]["status"]) == (None, "invalid")
    assert {r["g"]: r["q50"] for r in profile.distribution(table, ["g"], F.col("v")).collect()}[None] == 2.0
    people = spark.createDataFrame([(None, 1.0, 1), (None, 9.0, 2), (None, 2.0, 3), ("a", 4.0, 4)], "g string, v double, k bigint")
    near = {r["g"]: (r["median"], r["representative"], r["extreme"]) for r in profile.representative_and_extreme(people, ["g"], "v", "k").collect()}
    assert near == {None: (2.0, 3, 2), "a": (4.0, 4, 4)}
    ratio = evaluation.ratio_of_medians(people, ["g"], F.col("v"), F.col("k") > 1, F.col("k") < 4).collect()
    assert {r["g"]: (r["top"], r["bottom"], r["status"]) for r in ratio} == {None: (5.5, 2.0, "valid"), "a": (4.0, None, "invalid")}


def test_quantiles_by_brackets_are_exact(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SMALL", 100)
    monkeypatch.setattr(quantiles, "ACCURACY", 300)
    pick = random.Random(4)
    values = {"outlier": [pick.random() for _ in range(6000)] + [1e9], "equal": [3.0] * 2000, "few": [float(i) for i in range(50)], "ties": [float(i % 7) for i in range(3001)], "none": [None]}
    table = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g string, v double").repartition(5)
    names = {"q01": 0.01, "q50": 0.5, "q90": 0.9, "q100": 1.0}
    said = {r["g"]: r for r in quantiles.quantiles(table, ["g"], F.col("v"), names).collect()}
    for g, vs in values.items():
        for name, q in names.items():
            assert said[g][name] is None if g == "none" else said[g][name] == pytest.approx(np.quantile(vs, q), abs=1e-12)
    whole = quantiles.quantiles(table, [], F.col("v"), {"m": 0.5}).collect()
    assert len(whole) == 1 and whole[0]["m"] == pytest.approx(np.quantile([v for vs in values.values() for v in vs if v is not None], 0.5))
    assert quantiles.quantiles(table.limit(0), ["g"], F.col("v"), names).count() == 0


def test_numbers_are_written_as_json_writes_them(spark):
    pick = random.Random(1)
    values = [0.0, -0.0, 1.0, -2.5, 1e7, 12345678.9, 1e15, 123456789012345.6, 1e16, 1.5e16, 1e22, 1e100, 1.7e308, 1e-3, 1.25e-4, 1e-4, 9.9e-5, 1e-5, 5e-324, 1e-100, 0.1, 1 / 3]
    values += [pick.choice([-1, 1]) * pick.random() * 10.0 ** pick.randint(-30, 30) for _ in range(400)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", scalar.canonical_number(F.col("v")).alias("t")).collect()
    assert [(r["t"], r["v"]) for r in rows if r["t"] != repr(r["v"] + 0.0)] == []
    with pytest.raises(Exception, match="not finite"):
        spark.createDataFrame([(float("nan"),)], "v double").select(scalar.canonical_number(F.col("v"))).collect()
    text = spark.createDataFrame([('a"b\\n', None, 1.5)], "s string, n string, x double")
    inner = scalar.canonical_object({"x": scalar.canonical_number(F.col("x"))})
    said = text.select(scalar.canonical_object({"s": scalar.canonical_text(F.col("s")), "n": scalar.canonical_text(F.col("n")), "b": inner}).alias("j")).first()["j"]
    assert said == json.dumps({"b": {"x": 1.5}, "n": None, "s": 'a"b\\n'}, separators=(",", ":"))


def test_keyed_digests_addresses_ids_and_halves(spark):
    one = spark.createDataFrame([("message",)], "m string")
    assert one.select(scalar.hmac_sha256(b"key", F.col("m")).alias("h")).first()["h"] == hmac.new(b"key", b"message", hashlib.sha256).hexdigest()
    texts = ["10.1.2.3", "::ffff:10.1.2.3", " 10.1.2.3 ", "10.1.2.256", "10.1.2", "10.1.2.3.4", "010.1.2.3", "", "x", None, "2001:db8::1", "10.1.2.3."]
    said = spark.createDataFrame([(t,) for t in texts], "t string").select("t", scalar.address_number(F.col("t")).alias("n"), scalar.in_network(F.col("t"), "10.0.0.0/8").alias("i")).collect()
    assert [r["n"] for r in said] == [167838211] * 3 + [None] * 9 and [r["i"] for r in said] == [True] * 3 + [False] * 9
    hops = spark.createDataFrame([("1.1.1.1, 2.2.2.2, 9.9.9.9",), ("9.9.9.9",)], "h string")
    assert [r[0] for r in hops.select(scalar.client_of_forwarded(F.col("h"), ["9.9.9.9"])).collect()] == ["2.2.2.2", "9.9.9.9"]
    pick = random.Random(2)
    values = [0.0, 1.0, -8.0, 65504.0, 65519.0, 65520.0, 6e-8, 2.0**-14, 2.0**-24, 2049.0, 2051.0, 0.1] + [pick.uniform(-1, 1) * 2.0 ** pick.randint(-24, 15) for _ in range(300)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", scalar.half_precision(F.col("v")).alias("h")).collect()
    with np.errstate(over="ignore"):
        assert all(r["h"] == float(np.float64(r["v"]).astype(np.float16)) for r in got)
    centres = spark.range(5).select(scalar.nearest_center(F.col("id"), 5, 11).alias("c")).collect()
    assert [r["c"] for r in centres] == [0, 2, 5, 8, 10]  # 2.5 and 7.5 go to the even cell
    assert spark.range(1).select(scalar.to_unit_range(F.lit(15.0), 10.0, 20.0).alias("u")).first()["u"] == 0.0


def test_strict_objects(spark):
    texts = {'{"a":1,"b":[1,{"c":2}]}': None, '{"a":1,"a":2}': "repeated key", '{"a":NaN}': "number is not finite", '{"a":1e999}': "number is not finite", "[1]": "not an object", "{": "not JSON", '{"a":{"b":{"c":{}}}}': "too deep", '{"a":1,"b":2,"c":3,"d":4}': "too many keys", '{"a":"' + "x" * 300 + '"}': "too large"}
    rows = spark.createDataFrame([*((t,) for t in texts), (None,)], "t string")
    said = {r["t"]: r["refused"] for r in strict.strict_objects(rows, "t", most_depth=3, most_keys=3, most_bytes=200).collect()}
    assert said == texts | {None: "missing"}


def test_files_are_those_of_a_manifest(spark, tmp_path):
    for name, content in (("a", b"one"), ("b", b"two"), ("c", b"three"), ("e", b"x" * 50)):
        (tmp_path / name).write_bytes(content)
    found = files.bounded_files(spark, str(tmp_path), most_bytes=20).withColumn("path", F.regexp_extract("path", "[^/]+$", 0))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    manifest = spark.createDataFrame([("a", 3, sha(b"one")), ("b", 3, sha(b"owt")), ("c", 4, sha(b"three")), ("d", 1, sha(b"d")), ("e", 50, sha(b"x" * 50))], "path string, size bigint, sha256 string")
    assert {r["path"]: r["status"] for r in strict.verified_files(manifest, found).collect()} == {"a": "good", "b": "wrong digest", "c": "wrong size", "d": "missing", "e": "unread"}
    (tmp_path / "f").write_bytes(b"f")
    assert {r["path"]: r["status"] for r in strict.verified_files(manifest, files.bounded_files(spark, str(tmp_path), most_bytes=90).withColumn("path", F.regexp_extract("path", "[^/]+$", 0))).collect()} == {"a": "good", "b": "wrong digest", "c": "wrong size", "d": "missing", "e": "good", "f": "extra"}


def test_parquet_within_caps(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).repartition(3).write.parquet(path)
    schema = T.StructType([T.StructField("id", T.LongType())])
    caps = {"most_rows": 1000, "most_row_groups": 3, "most_bytes": 1 << 20}
    assert strict.bounded_parquet(spark, path, schema, **caps).count() == 1000
    for less in ({"most_rows": 999}, {"most_row_groups": 2}, {"most_bytes": 100}):
        with pytest.raises(ValueError, match="more than"):
            strict.bounded_parquet(spark, path, schema, **(caps | less))
    with pytest.raises(ValueError, match="columns differ"):
        strict.bounded_parquet(spark, path, T.StructType([T.StructField("id", T.IntegerType())]), **caps)


def test_published_tables_are_opened_by_their_marker(spark, tmp_path):
    path = str(tmp_path / "t")
    times = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            times.add(batch.num_rows)
            yield batch

    assert files.publish(spark.range(50).coalesce(1).mapInArrow(seen, "id bigint"), path)
    assert times.value == 50  # written and digested in one evaluation
    assert files.open_published(spark, path).count() == 50
    spark.range(3).write.mode("append").parquet(path)
    with pytest.raises(ValueError, match="does not hold"):
        files.open_published(spark, path)
    spark.range(3).write.parquet(str(tmp_path / "u"))
    with pytest.raises(ValueError, match="no marker"):
        files.open_published(spark, str(tmp_path / "u"))


def test_a_log_takes_what_follows(spark, tmp_path):
    path, schema = str(tmp_path / "log"), "run string, epoch bigint"
    files.append_batch(spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], schema), path, "run", "epoch")
    files.append_batch(spark.createDataFrame([("a", 3)], schema), path, "run", "epoch")
    for wrong in ([("a", 5)], [("b", 1)], [("a", 4), ("a", 4)], [("c", 2)], [("b", 2), ("b", 4)]):
        with pytest.raises(ValueError, match="do not follow"):
            files.append_batch(spark.createDataFrame(wrong, schema), path, "run", "epoch")
    kept = files.rolled_back(spark, path, spark.createDataFrame([], schema).schema, "epoch", 1).collect()
    assert sorted(map(tuple, kept)) == [("a", 1), ("b", 1)]


def test_distances_to_an_ellipse_by_hand(spark):
    cells = spark.createDataFrame([(0, 0), (0, 4), (2, 0), (0, 8), (4, 0)], "y int, x int")
    said = {(r["y"], r["x"]): r["sdf"] for r in grid.ellipse_distance(cells, 0, 0, 4, 2, 0).collect()}
    assert said == {(0, 0): -2.0, (0, 4): 0.0, (2, 0): 0.0, (0, 8): 2.0, (4, 0): 2.0}
    turned = {(r["y"], r["x"]): round(r["sdf"], 12) for r in grid.ellipse_distance(cells, 0, 0, 4, 2, 90).collect()}
    assert turned[4, 0] == 0.0 and turned[0, 4] == 2.0
    box = grid.bounding_box(grid.ellipse_distance(grid.lattice(spark.createDataFrame([("c",)], "case_id string"), 21, 31), 10, 15, 4, 2, 0), 1.0).first()
    assert (box["y0"], box["y1"], box["x0"], box["x1"]) == (7, 13, 9, 21) and box["least_on_side"] == pytest.approx(1.0)


def test_losses_are_means_over_all_cells(spark):
    cells = spark.createDataFrame([("c", True, 1.0, 2.0, 0.0, 0.0), ("c", False, 3.0, 9.0, 4.0, 9.0)], "case_id string, fluid boolean, pred_u double, sol_u double, pred_v double, sol_v double")
    said = grid.masked_loss(cells, ["u", "v"], floor=1e-6).first()
    assert (said["loss_u"], said["loss_v"], said["loss_obstacle"]) == (0.25, 0.0, 12.5)


def test_stretches_give_what_whole_keys_give(spark):
    pick = random.Random(8)
    rows = [(pick.choice("ab"), pick.randint(-500, 3000), i, pick.random()) for i in range(400)]
    table = spark.createDataFrame(rows, "k string, at bigint, id bigint, v double")

    def ordered(k):
        return sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))

    trailing = {r["id"]: (r["n_trailing"], round(r["trailing_mean"], 9)) for r in series.trailing_mean(table, ["k"], "at", "v", 100).collect()}
    for k, at, i, _ in rows:
        near = [r[3] for r in rows if r[0] == k and at - 100 < r[1] <= at]
        assert trailing[i] == (len(near), round(sum(near) / len(near), 9))
    last = sorted(r["id"] for r in series.debounced(table, ["k"], "at", ["id"], 15).collect())
    want = [r[2] for k in "ab" for r, n in zip(ordered(k), [*ordered(k)[1:], None], strict=True) if n is None or n[1] - r[1] > 15]
    assert last == sorted(want)
    progress = {r["id"]: r["accepted"] for r in series.monotone_progress(table, ["k"], ["at", "id"], "v", 70).collect()}
    sums = {r["id"]: r["s"] for r in series.running(table, ["k"], "at", 70, ["at", "id"], {"s": F.col("id")}).collect()}
    for k in "ab":
        top, total = -1.0, 0
        for r in ordered(k):
            total += r[2]
            assert progress[r[2]] == (r[3] > top) and sums[r[2]] == total
            top = max(top, r[3])
    said = {r["k"]: r for r in series.regularity(table, ["k"], "at", 70).collect()}
    for k in "ab":
        steps = [b[1] - a[1] for a, b in zip(ordered(k), ordered(k)[1:], strict=False)]
        assert (said[k]["n"], said[k]["n_steps"], said[k]["least"], said[k]["greatest"]) == (len(steps) + 1, len(set(steps)), min(steps), max(steps))


def test_cursors_ahead_fail(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, s bigint")
    assert [(r["k"], r["s"]) for r in series.replay(rows, ["k"], "s", F.lit(1)).collect()] == [("a", 2)]
    with pytest.raises(Exception, match="ahead of the events of b"):
        series.replay(rows, ["k"], "s", F.lit(2)).collect()
    assert [tuple(r) for r in series.future_cursors(rows, ["k"], "s", F.lit(2)).collect()] == [("b", 2, 1)]


def test_artifacts_with_null_digests(spark):
    expected = spark.createDataFrame([("a", None), ("b", None), ("c", "1"), ("d", "1")], "k string, sha string")
    found = spark.createDataFrame([("a", None), ("b", "2"), ("c", "1"), ("e", None)], "k string, sha string")
    assert {r["k"]: r["status"] for r in checks.artifact_difference(expected, found, "k", "sha").collect()} == {"a": "same", "b": "stale", "c": "same", "d": "missing", "e": "extra"}
    assert sorted(map(tuple, checks.key_difference(expected, found, "k").collect())) == [("d", "left"), ("e", "right")]


def test_array_contract(spark):
    rows = [("a", [1.0, 2.0]), ("a", None), ("a", [1.0]), ("b", [math.nan, 1.0]), ("b", [None, 1.0]), ("b", [math.inf, 0.0])]
    said = {r["g"]: tuple(r)[1:] for r in checks.array_contract(spark.createDataFrame(rows, "g string, x array<double>"), ["g"], "x", 2).collect()}
    assert said == {"a": (3, 2, 0), "b": (3, 0, 3)}


def test_a_rollup_does_not_depend_on_partitions(spark):
    rows = spark.range(500).select((F.col("id") % 3).alias("g"), "id", F.sha2(F.col("id").cast("string"), 256).alias("d"))
    said = [sorted(map(tuple, evidence.rollup_digest(r, ["g"], F.floor(F.col("id") / 64), ["id"], "d").collect())) for r in (rows, rows.repartition(9), rows.orderBy(F.desc("id")))]
    assert said[0] == said[1] == said[2]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    parts = {}
    for i in range(0, 500, 3):
        parts.setdefault(i // 64, []).append(sha(str(i)))
    below = sha(",".join(f"{p}:{sha(''.join(ds))}" for p, ds in sorted(parts.items())))
    assert said[0][0][1:] == (167, sha(f"0:{below}"))
    assert evidence.rollup_digest(rows.filter("id <> 7"), ["g"], F.floor(F.col("id") / 64), ["id"], "d").filter("g = 1").first()["digest"] != dict((g, d) for g, _, d in said[0])[1]


def test_guarded_means(spark):
    rows = spark.createDataFrame([("a", 0.1, 1.0, True), ("a", 0.3, 3.0, True), ("b", 0.5, 1.0, True), ("b", 0.7, 1.0, None)], "g string, x double, w double, ok boolean")
    assert {r["g"]: round(r["x"], 12) for r in evidence.weighted_means(rows, ["g"], ["x"], "w", 4).collect()} == {"a": 0.25, "b": 0.6}
    said = {r["g"]: (r["share"], r["status"]) for r in evidence.share_passing(rows, ["g"], F.col("x") > 0.2, F.col("ok")).collect()}
    assert said == {"a": (0.5, "valid"), "b": (None, "invalid")}


def test_coverage_and_identities(spark):
    said = spark.createDataFrame([("p", 1), ("p", 2), ("p", 2), ("q", 1), ("q", 9)], "who string, k bigint")
    cases = spark.createDataFrame([(1,), (2,), (3,)], "k bigint")
    assert {r["who"]: tuple(r)[1:] for r in evidence.coverage(said, cases, "who", "k").collect()} == {"p": (3, 1, 0, 1), "q": (3, 2, 1, 0)}
    known = [("no case", "k", cases), ("no name", "who", spark.createDataFrame([("p",)], "n string"))]
    assert sorted((r["who"], r["k"], r["status"]) for r in evidence.identities(said, known).collect()) == [("p", 1, "known"), ("p", 2, "known"), ("p", 2, "known"), ("q", 1, "no name"), ("q", 9, "no case")]


def test_maximin_takes_the_lowest_of_equal_designs(spark):
    rows = [(1, 0, 0.0), (1, 1, 2.0), (2, 0, 0.0), (2, 1, 3.0), (3, 0, 1.0), (3, 1, 4.0)]
    said = {r["c"]: (r["least_distance2"], r["chosen"]) for r in sampling.maximin(spark.createDataFrame(rows, "c bigint, i bigint, x double"), "c", "i", ["x"]).collect()}
    assert said == {1: (4.0, False), 2: (9.0, True), 3: (9.0, False)}
    pick = random.Random(5)
    many = [(1, i, pick.random(), pick.random()) for i in range(700)] + [(2, 0, 0.0, 0.0)]
    least = {r["c"]: r["least_distance2"] for r in sampling.maximin(spark.createDataFrame(many, "c bigint, i bigint, x double, y double"), "c", "i", ["x", "y"]).collect()}
    assert least[2] is None
    assert least[1] == pytest.approx(min((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 for i, a in enumerate(many[:700]) for b in many[i + 1 : 700]))
    # Clusters, points that coincide, null groups and points without a place.
    tight = [(3, i, 0.5 + pick.gauss(0, 1e-6 if i % 2 else 0.3), pick.random()) for i in range(900)]
    same = [(4, i, float(i // 2), 1.0) for i in range(200)]
    rest = [(None, i, float(i), 2.0 * i) for i in range(100)] + [(5, 1, None, 1.0), (5, 2, float("nan"), 1.0), (5, 3, 0.0, 0.0)]
    table = spark.createDataFrame(tight + same + rest, "c bigint, i bigint, x double, y double")
    least = {r["c"]: r["least_distance2"] for r in sampling.closest_pairs(table, "c", "i", ["x", "y"]).collect()}
    assert least[3] == pytest.approx(min((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 for i, a in enumerate(tight) for b in tight[i + 1 :]))
    assert (least[4], least[None], least[5]) == (0.0, 5.0, None)


def test_levels_of_settings_are_few(spark, monkeypatch):
    monkeypatch.setattr(sampling, "MOST_LEVELS", 3)
    assert sampling.probe_grid(spark.range(2), spark.range(3).withColumnRenamed("id", "level")).count() == 6
    with pytest.raises(ValueError, match="more than 3"):
        sampling.probe_grid(spark.range(2), spark.range(4).withColumnRenamed("id", "level"))


def test_nearest_with_many_copies_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(joins, "BLOCK_ROWS", 4)
    known = spark.createDataFrame([(1, 0.0)] * 50 + [(k, float(k)) for k in range(2, 20)], "k bigint, f double")
    asked = spark.createDataFrame([(100 + i, i + 0.4) for i in range(12)], "k bigint, f double")
    said = {r["k"]: r["nearest"] for r in joins.nearest(asked, known, "k", ["f"]).collect()}
    assert said == {100 + i: min([(abs(i + 0.4 - f), k) for k, f in [(1, 0.0)] + [(k, float(k)) for k in range(2, 20)]])[1] for i in range(12)}


def test_spectra_say_why_they_have_no_peak(spark):
    rows = [("good", i, math.sin(2 * math.pi * i / 10)) for i in range(200)] + [("slow", i, math.sin(2 * math.pi * i / 50)) for i in range(200)]
    rows += [("flat", i, 1.0) for i in range(200)] + [("short", 0, 1.0)] + [("odd", i, math.nan if i == 7 else 1.0 * i) for i in range(200)]
    table = spark.createDataFrame(rows, "k string, at bigint, v double")
    said = {r["k"]: r for r in series.spectral_peak(table, ["k"], "at", "v", 0.01, 0.4).collect()}
    assert {k: r["failure"] for k, r in said.items()} == {"good": None, "slow": "too_few_cycles", "flat": "flat", "short": "too_short", "odd": "not_finite"}
    assert said["good"]["frequency"] == pytest.approx(0.1, abs=1e-6)
    # Longer series go another way, to the same end.
    again = {r["k"]: r for r in series.spectral_peak(table, ["k"], "at", "v", 0.01, 0.4, direct=100).collect()}
    for k, r in said.items():
        assert again[k]["failure"] == r["failure"] and again[k]["n"] == r["n"]
        if r["failure"] is None:
            assert (again[k]["frequency"], again[k]["power"]) == pytest.approx((r["frequency"], r["power"]), rel=1e-9)


def test_prefixes_may_collide(spark):
    from millrace.operators import lineage

    nodes = spark.createDataFrame([("abcd1", "x"), ("abcd2", "x"), ("abce1", "x")], "sha string, kind string")
    edges = spark.createDataFrame([], "child string, parent string, parent_kind string")
    rules = spark.createDataFrame([("x", [], [])], "kind string, required array<string>, allowed array<string>")
    assert [tuple(r) for r in lineage.lineage_problems(nodes, edges, rules, prefix=4).collect()] == [("prefix_collision", "abcd")]
    assert lineage.lineage_problems(nodes, edges, rules, prefix=5).isEmpty()


def test_logs_of_json_lines_and_schemas(spark, tmp_path):
    schema = T.StructType([T.StructField("run", T.StringType()), T.StructField("epoch", T.LongType())])
    path = tmp_path / "log.jsonl"
    path.write_text('{"run":"a","epoch":1}\n{"run":"a","epoch":2}\n{"run":"b","epoch":1}\n')
    assert files.read_log(spark, str(path), schema, ["run"], "epoch").count() == 3
    path.write_text('{"run":"a","epoch":1}\n{"run":"a","epoch":3}\n')
    with pytest.raises(ValueError, match="gap"):
        files.read_log(spark, str(path), schema, ["run"], "epoch")
    path.write_text('{"run":"a","epoch":"x"}\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_log(spark, str(path), schema, ["run"], "epoch").collect()
    other = T.StructType([T.StructField("run", T.StringType()), T.StructField("epoch", T.IntegerType())])
    assert files.schema_digest(schema) == files.schema_digest(T.StructType.fromJson(schema.jsonValue())) != files.schema_digest(other)


def test_what_has_no_score_or_value_never_wins(spark):
    from millrace.operators import evidence, profile

    rows = [("a", 1, None), ("a", 2, 5.0), ("a", 3, 1.0), ("a", 4, float("nan")), ("n", 1, None), ("n", 2, None), (None, 7, 2.0), (None, 8, None)]
    table = spark.createDataFrame(rows, "g string, k bigint, s double")
    best = {r["g"]: (r["k"], r["s"]) for r in profile.best_of(table, ["g"], "s", "k").collect()}
    assert best == {"a": (3, 1.0), "n": (None, None), None: (7, 2.0)}
    said = {r["g"]: (r["median"], r["representative"], r["extreme"]) for r in profile.representative_and_extreme(table, ["g"], "s", "k").collect()}
    assert said == {"a": (3.0, 2, 2), "n": (None, None, None), None: (2.0, 7, 7)}
    told = {r["g"]: (r["latest"], r["best"], r["prunable"]) for r in evidence.pointers(table, "g", "k", "s").collect()}
    assert told == {"a": (4, 3, 2), "n": (2, None, 1), None: (8, 7, 0)}


def test_null_keys_stay_in_series(spark):
    from millrace.operators import evidence, series

    rows = [(k, 10 * i, 0.1 * i, "m") for k in ("a", None) for i in range(1, 4)]
    table = spark.createDataFrame(rows, "k string, t bigint, v double, m string")
    assert series.drift(table, ["k"], "t", "v").count() == 6
    assert series.running(table, ["k"], "t", 15, ["t"], {"s": F.lit(1)}).count() == 6
    assert sorted(r["s"] for r in series.running(table, ["k"], "t", 15, ["t"], {"s": F.lit(1)}).collect()) == [1, 1, 2, 2, 3, 3]
    assert series.monotone_progress(table, ["k"], ["t"], "v").filter("accepted").count() == 6
    assert series.replay(table, ["k"], "t", F.lit(10)).count() == 4
    assert series.last_range_mean(table, ["k"], "t", "v", 15).count() == 2
    assert evidence.barrier(table, ["k"], "t", "m", 1, 5).count() == 2
    long = spark.createDataFrame([(k, i, float(i % 3)) for k in ("a", None) for i in range(60)], "k string, t bigint, v double")
    assert {r["k"]: r["failure"] for r in series.spectral_peak(long, ["k"], "t", "v", 0.2, 0.45).collect()} == {"a": None, None: None}


def test_spectra_of_any_length_equal_the_direct_sum(spark):
    import numpy as np

    from millrace.operators.spectra import spectrum

    pick, rows, want = random.Random(6), [], {}
    for k, n in (("a", 1009), (None, 1000), ("c", 8), ("d", 4096)):
        values = [pick.gauss(0, 1) for _ in range(n)]
        rows += [(k, j, n, v) for j, v in enumerate(values)]
        want[k] = np.abs(np.fft.fft(values))
    got = spectrum(spark.createDataFrame(rows, "k string, __j bigint, __n bigint, __v double"), ["k"], 0.0, 0.5).collect()
    assert len(got) == sum(len(v) // 2 + 1 for v in want.values())
    assert max(abs(r["__p"] - want[r["k"]][r["__b"]]) for r in got) < 1e-9


def test_canonical_rows_equal_python(spark):
    import json

    schema = "z bigint, a struct<y: double, x: array<struct<k: string, v: double>>>, m map<string, array<boolean>>, s string"
    rows = [
        (1, {"y": -0.0, "x": [{"k": "é\"q", "v": 1e22}, None, {"k": None, "v": 0.1}]}, {"b": [True, None], "a": []}, "t\n"),
        (None, None, None, None),
        (-5, {"y": None, "x": []}, {}, ""),
    ]
    table = spark.createDataFrame(rows, schema)
    said = [r["j"] for r in table.coalesce(1).select(scalar.canonical_row(table.schema).alias("j")).collect()]
    plain = [dict(zip(("z", "a", "m", "s"), r, strict=True)) for r in rows]
    plain[0]["a"]["y"] = 0.0
    assert said == [json.dumps(p, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for p in plain]
    with pytest.raises(TypeError):
        scalar.canonical_row(spark.range(1).select(F.create_map("id", "id").alias("m")).schema)
