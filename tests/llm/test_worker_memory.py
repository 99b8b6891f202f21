"""Memory of Python workers, which outlive their stage."""

from domainlake.llm import packing
from domainlake.llm.common import forget_others
from domainlake.llm.mixing import mix


def test_worker_forgets_tokens_in_other_stages():
    packing._KNOWN["a"], packing._SIZES["a"] = ({"b": b"c"}, {}), packing.np.zeros(1)
    forget_others("tokens")
    assert packing._KNOWN and packing._SIZES
    forget_others(None)
    assert not packing._KNOWN and not packing._SIZES and not packing._TOKENIZERS


def test_mixing_evaluates_rates_once(spark):
    """Every evaluation in a plan has a Python worker of its own, which stays for the next stages."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("documents", "labels"))
    plan = mix(docs, labels)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
