"""From files to files: checked scans, scoring, attribution and the written result tables."""

import math

import numpy as np
import pytest

from porescreen.operators import attribute, score
from porescreen.plans.screening import score_and_explain
from porescreen.session import shared_folder
from porescreen.sources import tables, text

COLUMNS = ["E_max", "tortuosity", "PLD"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("files"))
    weights = [(0, o, i, 0.1 * (o + 1) * (i - 1)) for o in range(2) for i in range(3)] + [(1, 0, i, 1.0 + i) for i in range(2)]
    bias = [(0, o, 0.5, 1.0, 0.0, 0.0, 1.0) for o in range(2)] + [(1, 0, 0.25, None, None, None, None)]
    spark.createDataFrame(weights, "layer int, out int, in int, w double").write.parquet(f"{path}/weights.parquet")
    spark.createDataFrame(bias, "layer int, out int, b double, gamma double, beta double, mean double, var double").write.parquet(f"{path}/bias.parquet")
    spark.createDataFrame([(0, 0, 3), (0, 1, 3), (1, 0, 2)], "layer int, out int, n_in int").write.parquet(f"{path}/widths.parquet")
    spark.createDataFrame([(i, c, 1.0 * i, 2.0) for i, c in enumerate(COLUMNS)], "pos int, feature string, mean double, scale double") \
        .write.parquet(f"{path}/features.parquet")
    with open(f"{path}/background.csv", "w") as file:
        file.write("Emax,Pτ,PLD1,other\n1,2,3,a\n3,n/a,1,b\n5,1,4,c\n2,2,2,d\n")
    with open(f"{path}/external.csv", "w") as file:
        file.write("Zeolites,FDSi,Vacc,ASA\n MFI ,17.9,x,3\n")
    return path


def test_scans_name_what_is_missing(spark, folder):
    row = tables.read_external(spark, f"{folder}/external.csv").first()
    assert (row["match_key"], row["FDSi"], row["Vacc"], row["ASA"]) == ("mfi", 17.9, None, 3.0)
    with pytest.raises(ValueError, match="FDSi"):
        tables.read_external(spark, f"{folder}/background.csv")
    raw = tables.read_table(spark, f"{folder}/background.csv")
    assert tables.background_rows(raw, COLUMNS).count() == 3
    with pytest.raises(ValueError, match="no complete rows"):
        tables.background_rows(raw.filter("other = 'b'"), COLUMNS)
    with pytest.raises(ValueError, match="sigma_E"):
        tables.background_rows(raw, ["sigma_E"])


def test_weight_tables_must_match(spark, folder):
    from porescreen.operators.score import load_network

    weights, bias, widths = (tables.read_table(spark, f"{folder}/{t}.parquet") for t in ("weights", "bias", "widths"))
    with pytest.raises(ValueError, match="missing"):
        load_network(weights.filter("`in` > 0"), bias, widths=widths)


def test_results_are_written(spark, folder, tmp_path):
    network, order, scaler = tables.read_model(spark, folder)
    assert order == COLUMNS
    background = tables.background_rows(tables.read_table(spark, f"{folder}/background.csv"), order)
    features = spark.createDataFrame([("a", 1.0, 2.0, 3.0), ("b", 4.0, 1.0, 0.5), ("c", None, 1.0, 1.0), ("K", 2.0, 2.0, 2.0)],
                                     "sample string, E_max double, tortuosity double, PLD double")
    known = attribute.known_attributions(spark.createDataFrame([(0, " k", 1.5, 0.1, 0.2, 0.3)],
                                         "pos int, name string, base double, E_max double, tortuosity double, PLD double"), order, "pos")
    result = score_and_explain(features, network, order, scaler, background, known)
    paths = tables.write_tables(result, str(tmp_path)) + tables.write_tables({"diffusivity": result["diffusivity"]}, str(tmp_path), "csv")
    assert len(paths) == 5 and spark.read.parquet(f"{tmp_path}/nomenclature.parquet").filter("definition <> ''").count() == 13
    found = {r["sample"]: r for r in spark.read.parquet(f"{tmp_path}/attributions.parquet").collect()}
    scores = {r["sample"]: r["Ds_pred"] for r in spark.read.parquet(f"{tmp_path}/descriptors.parquet").collect()}
    assert {s: r["source"] for s, r in found.items()} == {"a": "computed", "b": "computed", "K": "known"} and scores["c"] is None
    for s in "ab":  # contributions lead from the base to the prediction
        assert found[s]["orig_pred"] == pytest.approx(scores[s])
        assert found[s]["orig_base"] + sum(found[s][c] for c in order) == pytest.approx(scores[s])
    assert found["K"]["orig_base"] == pytest.approx(math.exp(1.5))
    assert tables.read_table(spark, f"{tmp_path}/diffusivity.csv").count() == 3


def test_background_sample_at_thirteen_features(spark):
    """The sample against every row of the background: same base, attributions within the stated bound."""
    rng = np.random.default_rng(3)
    d, n = 13, 1200
    features = [f"f{i}" for i in range(d)]
    net = score.Network(tuple(rng.normal(size=s) / s[1] ** 0.5 for s in ((16, d), (16, 16), (8, 16), (1, 8))),
                        tuple(rng.normal(size=k) for k in (16, 16, 8, 1)), "relu")
    rows, x = rng.normal(size=(n, d)), rng.normal(size=(2, d))
    background = spark.createDataFrame([(f"b{k}", *map(float, r)) for k, r in enumerate(rows)], ["id", *features]).repartition(5)
    samples = spark.createDataFrame([(f"s{k}", *map(float, r)) for k, r in enumerate(x)], ["name", *features])
    drawn, base = attribute.background_sample(background, features, net, most=128, key="id")
    again, _ = attribute.background_sample(background.repartition(2), features, net, most=128, key="id")
    found = drawn.orderBy("bin", "part").collect()
    same = again.orderBy("bin", "part").collect()
    assert [(r["bin"], r["part"], r["f0"]) for r in found] == [(r["bin"], r["part"], r["f0"]) for r in same] and 64 < len(found) <= 128 + 32
    weights = np.array([r["weight"] for r in found])
    assert base == pytest.approx(net(rows).mean()) and weights.sum() == pytest.approx(n)
    assert net(np.array([[r[f] for f in features] for r in found])) @ weights / n == pytest.approx(base)
    got = {r["name"]: r for r in attribute.shapley_values(samples, background, "name", features, net, most=128, key="id").collect()}
    full = {r["name"]: r for r in attribute.shapley_values(samples, background, "name", features, net, most=n).collect()}
    spread = np.ptp(net(rows))
    for k in range(2):
        a, b = np.array([got[f"s{k}"][f] for f in features]), np.array([full[f"s{k}"][f] for f in features])
        assert got[f"s{k}"]["base_value"] == pytest.approx(base) == full[f"s{k}"]["base_value"]
        assert a.sum() == pytest.approx(net(x[k:k + 1])[0] - base) == pytest.approx(b.sum())
        assert np.abs(a - b).max() < spread * math.sqrt(math.log(2 / 0.01) / 256)
    # A background of few rows enters as it is.
    few, _ = attribute.background_sample(background.limit(50), features, net)
    assert few.count() == 50 and few.where("weight <> 1").isEmpty()


def test_checkpoint_folder_is_required_on_a_cluster(spark):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        class _jsc:  # noqa: N801
            @staticmethod
            def sc():
                return Context

        @staticmethod
        def getCheckpointDir():
            class Nothing:
                @staticmethod
                def isDefined():
                    return False
            return Nothing

    class Session:
        conf, sparkContext = Conf(), Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())


def test_line_numbers_of_split_files(spark, tmp_path):
    """A file of many splits, small ones beside it, and a file in parts give every line its number."""
    long = [f"{k} " + "x" * (k % 37) for k in range(30_000)]
    (tmp_path / "long.txt").write_text("\n".join(long) + "\n")
    (tmp_path / "short.txt").write_text("one\r\ntwo\n\nfour")
    (tmp_path / "other.log").write_text("no")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        lines = text.read_lines(spark, str(tmp_path), "*.txt", "file")
        assert lines.rdd.getNumPartitions() > 1
        found = {(r["file"], r["line_no"]): r["line"] for r in lines.collect()}
        assert found == {("long", k): x for k, x in enumerate(long)} | {("short", k): x for k, x in enumerate(["one", "two", "", "four"])}
        text.write_lines(lines.repartition(7), f"{tmp_path}/out", "file", part_lines=9_000)
        again = {(r["file"], r["line_no"]): r["line"] for r in text.read_written_lines(spark, f"{tmp_path}/out", "file").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert again == found
    assert {r["file"]: r["parts"] for r in text.list_written(spark, f"{tmp_path}/out", "file").collect()} == {"long": 4, "short": 1}


def test_many_names_are_written_to_few_files(spark, tmp_path):
    """Names with any character, gaps and tabs in lines; as many files as tasks, however many names there are."""
    rows = [(n, k, f"{k}\t{n}\t") for n in ["a/b", "ü =%", "", "tab\there", *map(str, range(300))] for k in (0, 1, 5)] + [("a/b", 7, "")]
    lines = spark.createDataFrame(rows, "file string, line_no long, line string")
    text.write_lines(lines, f"{tmp_path}/out", "file", part_lines=4)
    assert sorted(map(tuple, text.read_written_lines(spark, f"{tmp_path}/out", "file").collect())) == sorted(rows)
    assert len(list((tmp_path / "out").rglob("part-*.txt"))) <= 4
    listed = {r["file"]: (r["parts"], r["bytes"]) for r in text.list_written(spark, f"{tmp_path}/out", "file").collect()}
    assert listed["a/b"] == (2, 3 * (len("0\ta/b\t") + 1) + 1) and listed[""] == (2, 12) and len(listed) == 304
