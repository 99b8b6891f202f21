"""Registered queries; importing this package fills the registry, in this order."""

from domainlake.plans import feeds, urls, features, scoring  # noqa: F401, I001
from domainlake.plans import behaviour, kpis, corpus, squats, pages  # noqa: F401, I001
from domainlake.plans import models, streams  # noqa: F401, I001
from domainlake.plans.catalog import ORACLES, QUERIES  # noqa: F401
