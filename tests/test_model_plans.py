from domainlake.models import forest, isolation
from domainlake.plans import models
from domainlake.plans.views import Views


def test_registered_models_are_whole_variants(spark):
    v = Views(spark, "/root/testdata/sf0.001")
    fitted, want = models.fitted_forest(v), forest.VARIANTS["enhanced"]
    assert fitted.getNumTrees == want["numTrees"] and fitted.getOrDefault("maxDepth") == want["maxDepth"]
    assert models.fitted_isolation(v).nodes.select("tree").distinct().count() == isolation.VARIANTS["enhanced"]["trees"]
