"""Patterns with a guard give what the plain ones give, and scans score their rows once."""

import re

from pyspark.sql import functions as F

from postmill.functions import text as T
from postmill.functions.dialect import bounded
from postmill.functions.vocab import TECH_TERMS
from postmill.plans import service


def test_guarded_terms(spark):
    texts = ["node.js next.js", "c++17 asp.net c#x f#", "k8s, aws gcp-azure", "rest  api ci/cd devops", "machine learning xdeep learning", "scikit-learn .net", "anode.js", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for group in TECH_TERMS:
        guarded = T._any_of(group)
        assert guarded.startswith("(?=[") and all(re.match(guarded[: guarded.index(")") + 1], T.literals(t)[0]) for t in group)
        both = [F.regexp_extract_all("t", F.lit(p), F.lit(0)) for p in (guarded, "|".join(map(bounded, group)))]
        assert df.filter(both[0] != both[1]).count() == 0


def test_scan_has_no_sort(spark, sf_dir):
    assert "Sort" not in service.scan_threshold(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
