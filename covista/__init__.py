"""covista: co-view affinity graphs and product communities on Spark.

Page views and a product table go in; pair statistics, PMI-weighted SKU graphs and communities
come out, for all categories in one Spark job.
"""

from .params import Params, fixture_params  # noqa: F401
from .runtime import KEY, local_session  # noqa: F401
