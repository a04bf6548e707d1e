"""Alerts, tiers and the capacity-capped deployment plan.

Everything is a column expression or a window over a small partition
(one corridor-day plan); there is no per-row Python loop.  The greedy
allocation has a closed form:  processing a plan's alerts by risk
(descending, then sequence), the units left before alert ``i`` are
``max(0, cap - sum(requests before i))``, so ``alloc_i = min(request_i,
left_i)`` is a running sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripple import constants as K
from ripple.functions import columns as X
from ripple.operators.prefix import blocked_rank, blocked_sum_before, hour_block

# Linear stand-in score: (feature, weight in percent points).  Lets the whole
# alert -> plan chain be checked exactly against SQL without a trained model.
STANDIN_TERMS = (
    ("corridor_events_2h", 5),
    ("seed_event_present_3h", 25),
    ("is_peak_hour", 5),
    ("requires_road_closure", 10),
)
STANDIN_RISK_WEIGHT = 30

# What an alert is made of, besides its risk.
ALERT_INPUTS = ("id", "corridor", "date", "start_datetime", "start_local", "hour_of_day", "event_cause_grouped",
                "time_label", "requires_road_closure", "predicted_secondary_count", "police_station", "zone")
DRIVERS = ("driver_top3", "driver_values3")


def _standin_parts():
    parts = [(name, F.col(name).cast("long") * w) for name, w in STANDIN_TERMS]
    parts.append(("corridor_risk_score",
                  F.floor(F.col("corridor_risk_score") * STANDIN_RISK_WEIGHT).cast("long")))
    return parts


def standin_score(df: DataFrame) -> DataFrame:
    """Deterministic risk in [0, 1] (2 decimals) from look-back features."""
    total = None
    for _, p in _standin_parts():
        total = p if total is None else total + p
    pct = F.least(total, F.lit(100))
    return df.withColumns({
        "risk_pct": pct.cast("long"),
        "cascade_probability": pct.cast("double") / F.lit(100.0),
        "predicted_secondary_count": F.col("corridor_events_2h").cast("long"),
    })


def standin_drivers(df: DataFrame, top: int = 3) -> DataFrame:
    """M6 for the stand-in score: its per-feature terms, top ``top`` labels."""
    terms = F.array(*[
        F.struct((p.cast("double") / F.lit(100.0)).alias("v"), F.lit(i).alias("i"),
                 F.lit(K.FEATURE_LABELS.get(name, name)).alias("label"))
        for i, (name, p) in enumerate(_standin_parts())])
    ranked = F.slice(F.array_sort(terms, lambda a, b: F.when(a["v"] > b["v"], -1)
                                  .when(a["v"] < b["v"], 1)
                                  .when(a["i"] < b["i"], -1).when(a["i"] > b["i"], 1).otherwise(0)),
                     1, top)
    return df.withColumns({
        "driver_top3": F.transform(ranked, lambda s: s["label"]),
        "driver_values3": F.transform(ranked, lambda s: F.greatest(s["v"], F.lit(K.CONTRIBUTION_FLOOR))),
    })


def request(df: DataFrame, risk: str = "cascade_probability") -> DataFrame:
    """Confidence band, base request by risk, cause add-ons."""
    r = F.col(risk)
    hi, mid, lo = K.BASE_REQUESTS

    def pick(idx):
        return F.when(r >= hi[0], F.lit(hi[idx])).when(r >= mid[0], F.lit(mid[idx])).otherwise(F.lit(lo[idx]))

    cause = F.col("event_cause_grouped")
    hour = F.col("hour_of_day")
    closure = F.coalesce(F.col("requires_road_closure"), F.lit(False))
    return df.withColumns({
        "confidence_band": X.band(risk, K.CONFIDENCE_BANDS, "LOW"),
        "prio_flag": pick(4),
        "police_needed": pick(1).cast("long"),
        "breakdown_needed": (pick(2) + F.when(cause == "water_logging", 1).otherwise(0)).cast("long"),
        "barricades_needed": (pick(3)
                              + F.when((cause == "pot_holes") & hour.between(0, 6), 2).otherwise(0)
                              + F.when(closure, 2).otherwise(0)).cast("long"),
    })


def build_alerts(scored: DataFrame, threshold: float = 0.10,
                 caps=K.RESOURCE_CAPS, risk: str = "cascade_probability") -> DataFrame:
    """D1-D10 for every predicted seed of every corridor-day (flat columns).

    ``scored`` is the engineered table with a risk column and a predicted
    2 h count.  ``seq`` numbers the alerts of a corridor-day in time order.
    """
    cap = dict(caps)
    alerts = scored.where((F.col(risk) >= threshold) & F.col("start_local").isNotNull()).select(*dict.fromkeys(
        [risk, *ALERT_INPUTS, *(c for c in DRIVERS if c in scored.columns)]))     # the ranks store these rows
    # seq = row_number() over (corridor, date order by time, id), split by hour
    alerts = blocked_rank(alerts, ["corridor", "date"], hour_block("start_local"), ["start_local", "id"])
    alerts = request(alerts, risk)
    res_min = X.map_lookup("event_cause_grouped", K.AVG_RESOLUTIONS, K.DEFAULT_RESOLUTION_MIN)
    sample_n = X.map_lookup("event_cause_grouped", K.RESOLUTION_SAMPLE_N, K.DEFAULT_SAMPLE_N)
    clear_local = X.to_local(F.timestamp_add("MINUTE", res_min, F.col("start_datetime")))
    neighbour = X.map_lookup("zone", K.NEIGHBOUR_ZONES, K.DEFAULT_NEIGHBOUR)
    code = X.corridor_code("corridor")
    return alerts.select(
        F.concat(F.lit("ALERT-"), F.date_format("date", "yyyyMMdd"), F.lit("-"), code, F.lit("-"),
                 F.format_string("%03d", F.col("seq"))).alias("alert_id"),
        "id", "corridor", "date", "seq", "start_local", "hour_of_day",
        F.col("event_cause_grouped").alias("cause"),
        F.col("time_label").alias("time_ist"),
        F.col("requires_road_closure").alias("road_closure_required"),
        F.col(risk).alias("cascade_probability"),
        F.round(F.col(risk), 2).alias("risk_score"),
        F.col("predicted_secondary_count").alias("predicted_secondary_events_2h"),
        F.lit(K.TOP_CAUSE_EXPECTED).alias("top_cause_expected"),
        "confidence_band",
        X.deploy_message("police_needed", "breakdown_needed", "barricades_needed", "corridor")
        .alias("deploy_now"),
        F.coalesce(F.col("police_station"), F.lit("Unknown Station")).alias("alert_stations"),
        F.concat(F.lit("Activate additional 2 breakdown recovery units if secondary count exceeds "),
                 F.col("predicted_secondary_count").cast("string")).alias("standby"),
        "police_needed", "breakdown_needed", "barricades_needed",
        F.when(F.col("police_needed") > cap["traffic_police"],
               F.concat(F.lit("RESOURCE SHORTFALL: request backup from "), neighbour))
         .otherwise(F.lit(K.ALLOCATED_FLAG)).alias("police_flag"),
        "prio_flag",
        F.concat(F.date_format(clear_local, "yyyy-MM-dd HH:mm:ss"), F.lit(" IST (clears in "),
                 X.relative_duration(res_min), F.lit(")"),
                 F.when(sample_n < K.LIMITED_DATA_N, F.lit(" (estimate — limited data)"))
                  .otherwise(F.lit(""))).alias("estimated_clearance_ist"),
        *[c for c in DRIVERS if c in scored.columns],
    )


def nest_alerts(alerts: DataFrame) -> DataFrame:
    """The nested alert document (trigger / prediction / deployment)."""
    return alerts.select(
        "alert_id",
        F.struct(F.col("cause"), F.col("corridor"), F.col("time_ist"),
                 F.col("road_closure_required")).alias("trigger"),
        F.struct("risk_score", "predicted_secondary_events_2h", "top_cause_expected",
                 "confidence_band").alias("cascade_prediction"),
        F.struct(F.col("deploy_now").alias("DEPLOY_NOW"), F.col("alert_stations").alias("ALERT_STATIONS"),
                 F.col("standby").alias("STANDBY"), "police_needed", "breakdown_needed",
                 "barricades_needed", "police_flag", "prio_flag").alias("deployment"),
        "estimated_clearance_ist",
        *[c for c in DRIVERS if c in alerts.columns])


def allocate(alerts: DataFrame, caps=K.RESOURCE_CAPS, plan_keys=("corridor", "date")) -> DataFrame:
    """Greedy allocation by risk under per-plan caps, closed form.

    The requests before each alert (risk descending, then ``seq``) come from
    a two-level running sum: per (risk level, hour) block totals, then a
    window inside the block, so a busy plan is not one task.
    """
    cap = dict(caps)
    reqs = ["police_needed", "breakdown_needed", "barricades_needed"]
    blocks = [(F.col("risk_score"), False)]
    if "hour_of_day" in alerts.columns:       # seq follows time, so the hour refines the block
        blocks.append((F.col("hour_of_day"), True))
    out = blocked_sum_before(alerts, list(plan_keys), blocks, [F.col("seq").asc()], reqs)

    def alloc(req, total):
        return F.least(F.col(req), F.greatest(F.lit(0), F.lit(total) - F.col(f"_before_{req}"))).cast("long")

    out = out.withColumns({
        "deploy_police": alloc("police_needed", cap["traffic_police"]),
        "deploy_breakdown": alloc("breakdown_needed", cap["breakdown_units"]),
        "deploy_barricades": alloc("barricades_needed", cap["barricades"]),
    }).drop(*[f"_before_{r}" for r in reqs])
    short = ((F.col("deploy_police") < F.col("police_needed"))
             | (F.col("deploy_breakdown") < F.col("breakdown_needed"))
             | (F.col("deploy_barricades") < F.col("barricades_needed")))
    return out.withColumn("resource_flag",
                          F.when(short, F.lit(K.SHORTFALL_FLAG)).otherwise(F.lit(K.ALLOCATED_FLAG)))


def plan_columns(plan: DataFrame) -> DataFrame:
    """The 10-column plan projection."""
    return plan.select("alert_id", "corridor", "time_ist", F.col("cause").alias("seed_cause"),
                       "risk_score", "deploy_police", "deploy_breakdown", "deploy_barricades",
                       F.col("estimated_clearance_ist").alias("estimated_clearance"), "resource_flag")


def tiers(alerts: DataFrame, risk: str = "cascade_probability") -> DataFrame:
    """RED / AMBER / GREEN tier from the unrounded probability."""
    return alerts.withColumn("tier", X.band(risk, K.TIER_CUTS, "GREEN"))


def tier_actions(alerts: DataFrame) -> DataFrame:
    """Tier-specific resources, action text and status."""
    t = F.col("tier")
    cause = F.col("cause")
    corridor = F.col("corridor")
    police = (F.when(t == "RED", F.col("police_needed"))
               .when(t == "AMBER", F.greatest("police_needed", F.lit(2))).otherwise(F.lit(1)))
    bd = (F.when(t == "RED", F.col("breakdown_needed"))
           .when(t == "AMBER", F.greatest("breakdown_needed", F.lit(1)))
           .otherwise(F.when(cause.isin(*K.GREEN_BREAKDOWN_CAUSES), 1).otherwise(0)))
    barr = (F.when(t == "RED", F.col("barricades_needed"))
             .when(t == "AMBER", F.greatest("barricades_needed", F.lit(1)))
             .otherwise(F.when(cause.isin(*K.GREEN_BARRICADE_CAUSES), 1).otherwise(0)))
    out = alerts.withColumns({"police_disp": police.cast("long"), "breakdown_disp": bd.cast("long"),
                              "barricades_disp": barr.cast("long")})
    action = (F.when(t == "RED", F.col("deploy_now"))
               .when(t == "AMBER", F.concat(F.lit("Pre-position "), F.col("police_disp").cast("string"),
                                            F.lit(" traffic police and "),
                                            F.col("breakdown_disp").cast("string"),
                                            F.lit(" breakdown unit(s) near "), corridor))
               .otherwise(F.concat(F.lit("Dispatch 1 patrol officer to "), corridor,
                                   F.lit(" — routine monitoring"))))
    status = (F.when(t == "RED", F.col("police_flag"))
               .when(t == "AMBER", F.lit("STANDBY — Deploy on confirmation"))
               .otherwise(F.lit("ROUTINE MONITORING")))
    return out.withColumns({"action": action, "status": status})


def driver_shares(df: DataFrame, values: str = "driver_values3", digits: int = 2) -> DataFrame:
    """Contributions as shares of their sum (2 dp); 1/3 each if the sum is 0."""
    total = F.aggregate(F.col(values), F.lit(0.0), lambda acc, v: acc + v)
    return df.withColumn("driver_shares", F.when(total > 0, F.transform(
        F.col(values), lambda v: F.round(v / total, digits))).otherwise(
        F.array_repeat(F.lit(0.33), F.size(values))))


def alert_log(alerts: DataFrame, n: int = 5) -> DataFrame:
    """The most recent ``n`` RED/AMBER alerts."""
    return (alerts.where(F.col("tier").isin("RED", "AMBER"))
                  .select("alert_id", "corridor", "start_local", "tier",
                          F.format_string("%.0f%%", F.col("cascade_probability") * 100).alias("risk"),
                          "cause")
                  .orderBy(F.col("start_local").desc(), F.col("alert_id").desc())
                  .limit(n))


def status_text(prob: str, threshold: float):
    """``CASCADE SEED (NN% risk)`` / ``NO CASCADE (NN% risk)``."""
    pct = F.format_string("%.0f", F.col(prob) * 100)
    return F.when(F.col(prob) >= threshold, F.concat(F.lit("CASCADE SEED ("), pct, F.lit("% risk)"))) \
            .otherwise(F.concat(F.lit("NO CASCADE ("), pct, F.lit("% risk)")))


def whatif_flags(df: DataFrame, cause: str = "event_cause_grouped") -> DataFrame:
    """Flags a what-if scenario derives from the chosen cause."""
    c = F.col(cause)
    return df.withColumns({
        "is_heavy_vehicle": c.isin(*K.WHATIF_HEAVY_CAUSES).cast("long"),
        "seed_event_present_3h": c.isin(*K.WHATIF_SEED_CAUSES).cast("long"),
        "requires_road_closure": c.isin(*K.WHATIF_CLOSURE_CAUSES),
    })
