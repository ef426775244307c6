"""E1 and its ranking / scaling building blocks."""

from __future__ import annotations

from ...operators.scaling import ALL_COLUMNS, GROUPS
from ...oracle import with_fx
from ...registry import register
from ..labeling import labels_table

DIMS = ("size", "structure", "content")


def _scaled_sum_sql(cols: list[str]) -> str:
    parts = [f"(case when mx_{c} > mn_{c} then ({c} - mn_{c}) / (mx_{c} - mn_{c}) else 0.0e0 end)"
             for c in cols]
    return "round(" + " + ".join(parts) + ", 9)"


_STATS = ("st as (select " + ", ".join(f"min({c}) as mn_{c}, max({c}) as mx_{c}" for c in ALL_COLUMNS)
          + " from fx_features)")
_SCORES = ("sc as (select f.*, " + ", ".join(f"{_scaled_sum_sql(GROUPS[d])} as {d}_score" for d in DIMS)
           + " from fx_features f, st)")


def _e1_sql(p: float = 0.5, dp: float = 0.2) -> str:
    wins = ", ".join(
        f"row_number() over (order by {d}_score desc, sample_id, \"index\") as {d}_t, "
        f"row_number() over (order by {d}_score asc, sample_id, \"index\") as {d}_b" for d in DIMS)
    ranked = f"r as (select *, count(*) over () as n, {wins} from sc)"
    top = " and ".join(f"{d}_t <= ceil(n * {p})" for d in DIMS)
    bot = " and ".join(f"{d}_b <= ceil(n * {p})" for d in DIMS)
    dims = ", ".join(
        f"case when {d}_b <= ceil(n * {dp}) then 0 when {d}_t <= ceil(n * {dp}) then 2 else 1 end as {d}_label, "
        f"{d}_score" for d in DIMS)
    body = (f"select sample_id, \"index\", {', '.join(ALL_COLUMNS)}, "
            f"case when {bot} then 0 when {top} then 2 else 1 end as label, {dims} from r")
    return with_fx("fx_features", body, ",\n".join([_STATS, _SCORES, ranked]))


@register("e1_complexity_labels", _e1_sql())
def e1_complexity_labels(spark, sf_dir):
    """E1 writes its label table to the shared folder (E4, E5, E7, A17 and M* read
    it) and returns it read back."""
    return labels_table(spark, sf_dir, percent=0.5, dims_percent=0.2)
