from collections import Counter

from pyspark.sql import functions as F

from archivist.plans import registry
from tests.oracle import agree

SF = "/root/testdata/sf0.01"


def test_merge_covers_all_line_items(spark):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").withColumn("early", F.year("l_shipdate") < 1996).collect()
    assert len({r.early for r in rows}) == 2
    batches: tuple[dict, dict] = {}, {}
    for r in sorted(rows, key=lambda r: (r.l_orderkey, r.l_linenumber)):
        kind = "unknown" if r.l_returnflag == "N" else r.l_returnflag
        x = batches[not r.early].setdefault(str(r.l_partkey), {"href": f"h{r.l_suppkey}", "kind": kind, "author": r.l_linestatus, "at": r.l_shipdate, "lists": set()})
        x["at"] = max(x["at"], r.l_shipdate)
        x["lists"].add(kind)
    old, new = batches
    want = {}
    for k in old.keys() | new.keys():
        a, b = old.get(k), new.get(k)
        if not a or not b:
            want[k] = "added" if not a else "kept"
        else:
            changed = b["author"] != a["author"] or b["kind"] not in ("unknown", a["kind"]) or b["href"] != a["href"] or b["at"] > a["at"] or not b["lists"] <= a["lists"]
            want[k] = "updated" if changed else "skipped"
    got = registry.QUERIES["merge_outcomes_whole"](spark, SF).collect()
    assert len(got) == len(want) and {r.media_key: r.outcome for r in got} == want
    assert {r.outcome: r["items"] for r in registry.QUERIES["merge_outcome_counts_whole"](spark, SF).collect()} == Counter(want.values())
    n = registry.QUERIES["import_accounting_whole"](spark, SF).first()
    assert (n["added"], n["updated"]) == (len(new.keys() - old.keys()), len(new.keys() & old.keys()))


def test_equal_numbers_go_by_their_place_in_the_table(spark, tmp_path):
    rows = [(k, 7, 10 - n if k % 2 else n, 1, "NRA"[n % 3], "OF"[n % 2], f"199{8 - 4 * (k % 2)}-01-0{n + 1} 00:00:00") for k in range(8) for n in range(4)]
    rows += [(k, k, 10 * k + n, 1, "RAN"[n % 3], "FO"[n % 2], f"199{8 - 4 * (k % 2)}-01-0{9 - n} 00:00:00") for k in range(64, 80) for n in range(3)]
    df = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string, at string")
    df.select("*", F.to_timestamp("at").alias("l_shipdate")).drop("at").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    for name in ("merge_outcomes_whole", "merge_outcome_counts_whole", "import_accounting_whole", "merge_outcomes"):
        assert agree(spark, name, str(tmp_path))
