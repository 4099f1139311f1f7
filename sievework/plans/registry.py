"""All queries with their SQL; importing the query modules registers them."""

from . import q_features, q_flagship, q_metrics, q_models, q_ranks, q_scores, q_tables  # noqa: F401
from .views import QUERIES, SQL  # noqa: F401
