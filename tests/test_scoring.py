from vigilake.intel import BASELINE, Pack, merge, numbers, read_seeds, read_toml
from vigilake.operators.scoring import verdicts

FINDING = "scan_id long, rule_id string, category string, severity string"


def judge(spark, findings, rank=None):
    scans = spark.createDataFrame([(1, rank)], "scan_id long, watchlist_rank long")
    rows = spark.createDataFrame([(1, *x) for x in findings], FINDING)
    r = verdicts(scans, rows).first()
    return r.score, r.verdict, r.alert_tag


def test_goldens(spark):
    low, medium, high, critical = (("r." + s, "c", s) for s in ("low", "medium", "high", "critical"))
    assert judge(spark, []) == (0, "clean", None)
    assert judge(spark, [critical]) == (30, "malicious", None)
    assert judge(spark, [low] * 50) == (30, "suspicious", None)
    assert judge(spark, [low] * 5) == (5, "clean", None)
    assert judge(spark, [high]) == (25, "suspicious", None)
    assert judge(spark, [("malware.discord_webhook", "malware", "high")]) == (25, "malicious", None)
    assert judge(spark, [medium], 500) == (8, "suspicious", None)
    assert judge(spark, [high], 42) == (25, "malicious", "watchlist_top100")
    assert judge(spark, [("opengrep.shadow_x", "opengrep", "critical")]) == (0, "clean", None)
    assert judge(spark, [("a", "dynamic", "high"), ("b", "dynamic", "high"), ("c", "dynamic", "high")]) == (75, "malicious", None)
    assert judge(spark, [("x", "c", "unheard of"), (None, None, None)]) == (0, "clean", None)


def test_pack_merge():
    overlay = Pack(points={"low": 2}, thresholds={"category_cap": 40}, chains=frozenset({"x"}), lures={"crypto": ("coin", "wallet")}, benign_hosts=frozenset({"a.b"}), install_files={}, seeds=({"sha256": "aa", "label": "new"},), prompts={"p": ""})
    base = merge(Pack(seeds=({"sha256": "aa", "label": "old"},), prompts={"p": "kept"}), overlay)
    assert base.points == BASELINE.points | {"low": 2} and base.thresholds["category_cap"] == 40 and base.thresholds["malicious_min"] == 61
    assert "x" in base.chains and BASELINE.chains < base.chains and base.lures["crypto"][-1] == "coin" and base.lures["crypto"].count("wallet") == 1
    assert base.seeds == ({"sha256": "aa", "label": "old"},) and base.prompts == {"p": "kept"}
    assert read_seeds(['{"sha256": "AA"}', "# note", "broken", '{"no": 1}'])[1] == 2
    assert read_toml('chains = ["a"]\n[thresholds]\nmalicious_min = 50').thresholds == {"malicious_min": 50}
    try:
        numbers({"a": True})
        raise AssertionError
    except ValueError:
        pass
