"""Run parameters of the co-view clustering job, validated before any plan is built."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Fixed values of the job's interface: category columns a run may key on, the weight
# formulas and the community methods it knows.
CAT_LEVELS = ("SubCategory", "SubSubCategory")
NORMS = (1, 2, 3, 4, 5)
METHODS = (1, 2, 3, 4, 6, 7, 8)   # of the interface's codes 1 to 8, those that are built
VISIBLE_RULES = ("after", "on_or_after")
JOINT_MODES = ("daily_min", "row_weighted", "min_of_sums")

# Methods that return a dendrogram (cut at k, else at best modularity) and the ones
# that take a resolution parameter.
DENDROGRAM_METHODS = (1, 2)
RESOLUTION_METHODS = (7, 8)


@dataclass(frozen=True)
class Params:
    """All knobs of one run.  Defaults are those of the original job's constructor.

    ``category=None`` runs every category of ``cat_level`` at once, keyed by the
    column ``sub_category``; a value restricts the run to that one category.
    """

    start_date: str = "2016-01-01"
    end_date: str = "2016-05-01"
    cat_level: str = "SubCategory"
    category: str | None = None
    time_thresh: float = 5
    min_view_thresh: int = 5
    joint_view_thresh: int = 1
    pmi_perc: float = 5
    norm: int = 1
    method: int = 4
    k: int | None = None
    sg_gamma: float = 1.0
    sg_lambda: float = 1.0
    cl_size_thresh: int = 40
    sub_method: int = 8
    iter_count: int = 3
    visible_rule: str = "on_or_after"
    joint_mode: str = "daily_min"
    ordered: bool = False
    hot_visitor_skus: int = 2000      # block size used to split visitors with many SKUs; never changes results

    def validate(self) -> "Params":
        if self.cat_level not in CAT_LEVELS:
            raise ValueError(f"cat_level must be one of {CAT_LEVELS}, got {self.cat_level!r}")
        if self.norm not in NORMS:
            raise ValueError(f"norm must be one of {NORMS}, got {self.norm!r}")
        for name in ("method", "sub_method"):
            if getattr(self, name) not in METHODS:
                raise ValueError(f"{name} must be one of {METHODS}, got {getattr(self, name)!r}")
        if self.visible_rule not in VISIBLE_RULES:
            raise ValueError(f"visible_rule must be one of {VISIBLE_RULES}")
        if self.joint_mode not in JOINT_MODES:
            raise ValueError(f"joint_mode must be one of {JOINT_MODES}")
        if not 0 <= self.pmi_perc <= 100:
            raise ValueError("pmi_perc is a percentile in [0, 100]")
        if self.k is not None and self.k < 1:
            raise ValueError("k must be positive")
        if self.sg_gamma <= 0:
            raise ValueError("sg_gamma must be > 0")
        if self.sg_lambda < 0:
            raise ValueError("sg_lambda must be >= 0")
        if self.iter_count < 1 or self.cl_size_thresh < 1:
            raise ValueError("iter_count and cl_size_thresh must be >= 1")
        if self.hot_visitor_skus < 2:
            raise ValueError("hot_visitor_skus must be >= 2")
        if self.start_date >= self.end_date:
            raise ValueError("start_date must be before end_date")
        return self

    def with_(self, **kw) -> "Params":
        return replace(self, **kw).validate()

    @classmethod
    def production(cls, start_date: str = "2016-01-01", end_date: str = "2016-05-01") -> "Params":
        """The values the original job ran with in production."""
        return cls(start_date=start_date, end_date=end_date, cat_level="SubCategory",
                   time_thresh=10, min_view_thresh=3, joint_view_thresh=1, pmi_perc=50,
                   norm=1, method=4, k=None, sg_gamma=0.5, sg_lambda=0.5,
                   cl_size_thresh=30, sub_method=8, iter_count=5).validate()

    @classmethod
    def preset(cls, variant: str, **kw) -> "Params":
        """``batch``: the pure-Python job's choices; ``spark``: the Spark file's choices."""
        if variant == "batch":
            kw = {"joint_mode": "row_weighted", "visible_rule": "after", "ordered": False, **kw}
        elif variant == "spark":
            kw = {"joint_mode": "min_of_sums", "visible_rule": "on_or_after", "ordered": True, **kw}
        elif variant != "default":
            raise ValueError(f"unknown variant {variant!r}")
        return cls(**kw).validate()


def fixture_params(**kw) -> Params:
    """Parameters used against the driver tables (FIXTURES.md)."""
    base = dict(start_date="1995-01-01", end_date="2001-01-01", cat_level="SubCategory",
                time_thresh=10, min_view_thresh=3, joint_view_thresh=1, pmi_perc=50, norm=1,
                visible_rule="on_or_after", joint_mode="daily_min")
    base.update(kw)
    return Params(**base).validate()
