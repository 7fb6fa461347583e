"""The evidence tools with their weights, tiers, groups and domains, and the thresholds of the rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values, a row for each tool: name, fusion weight, registry weight, tier, gate weight, group, domain, runs on a GPU.
TOOLS = [
    ("check_c2pa", 0.05, 0.05, 1, 0.05, "provenance", "auth", False),
    ("run_dct", 0.09, 0.10, 2, 0.15, "compression", "freq", False),
    ("run_rppg", 0.06, 0.06, 2, 0.35, None, "bio_rppg", False),
    ("run_geometry", 0.12, 0.12, 3, 0.25, "physical", "phys", False),
    ("run_illumination", 0.04, 0.04, 1, 0.10, "physical", "illum", False),
    ("run_corneal", 0.04, 0.04, 2, 0.10, "physical", "bio_corn", False),
    ("run_univfd", 0.15, 0.09, 3, 0.0, "generation", None, True),
    ("run_xception", 0.15, 0.25, 2, 0.0, "swap", None, True),
    ("run_sbi", 0.15, 0.20, 3, 0.0, "swap", None, True),
    ("run_freqnet", 0.15, 0.05, 1, 0.0, "generation", None, True),
]
NAMES = [t[0] for t in TOOLS]
GPU = [t[0] for t in TOOLS if t[7]]

# Fixed values of the fusion rules.
DAMPED_BELOW = 0.60
CPU_SHARE = 0.15
SINGLE_CONFIDENCE, SINGLE_BOOST = 0.80, 0.12
MULTI_CONFIDENCE, MULTI_BOOST = 0.55, 0.10
FAKE_ABOVE, NEAR_MISS, NEAR_MISS_SLOPE, MASS_ABOVE = 0.50, 0.42, 0.50, 0.51
DOMINANCE, DOMINANCE_CONFIDENCE, LOGIT_DAMPING = 2.5, 0.40, 0.45
MIDDLE_LOW, MIDDLE_HIGH, MIDDLE_CONFIDENCE, MIDDLE_SCORE = 0.35, 0.55, 0.85, 0.85
COVERAGE = 0.02
INCONCLUSIVE_WEIGHT, INCONCLUSIVE_STD, CONFLICT_STD = 0.50, 0.25, 0.20
VERDICT_CUT = 0.54
OVERRIDE_WEIGHT, OVERRIDE_AGREE, OVERRIDE_CONTRADICT = 0.40, 0.35, 0.55


def tools(spark: SparkSession) -> DataFrame:
    """The ten-row dimension table; small enough to be broadcast wherever it is joined."""
    return spark.createDataFrame(TOOLS, "tool string, fusion_weight double, registry_weight double, tier int, gate_weight double, category string, domain string, gpu boolean")
