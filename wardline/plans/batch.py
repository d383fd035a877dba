"""The whole batch: raw records to stored layers, reports and the run's totals."""

from __future__ import annotations

from pyspark.sql import DataFrame

from wardline.operators import claims, gaps, gold as G, silver as S, stats
from wardline.sources import sinks
from wardline.sources.readers import read_layer


def run_batch(raw: DataFrame, out: str) -> DataFrame:
    """Writes bronze, silver, gold and gap layers and the CSV, failure and map outputs.

    Every layer is computed from the stored one below it, so a lost executor costs the
    tasks of one layer only. Returns the one-row summary.
    """
    spark, out = raw.sparkSession, out.rstrip("/")
    sinks.write_layer(raw, f"{out}/bronze")
    sinks.write_layer(S.clean_silver(read_layer(spark, f"{out}/bronze")), f"{out}/silver")
    sinks.write_layer(G.build_gold(read_layer(spark, f"{out}/silver")), f"{out}/gold",
                      partition_by="address_state")
    gold = read_layer(spark, f"{out}/gold")
    sinks.write_layer(gaps.gap_grid(gold), f"{out}/gaps")
    table = read_layer(spark, f"{out}/gaps")
    sinks.write_layer(gaps.state_summary(table), f"{out}/state_summary")
    sinks.write_csv(gold, f"{out}/gold_csv")
    sinks.write_csv(gaps.gap_sort(table), f"{out}/gaps_csv")
    sinks.write_failures(claims.split_failures(gold)[1], f"{out}/failures_csv")
    sinks.write_geojson(gold, f"{out}/features")
    sinks.write_feature_collection(gold, f"{out}/feature_collection")
    return stats.batch_summary(gold, table)
