"""The whole run, from files to reports."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areagrade.operators.scorecard import renamed
from areagrade.plans.exposure import TOO_LARGE, annual_exposure, area_volume, segment_names, stage_counts
from areagrade.plans.incidents import incident_profile, incident_stats, incident_totals, prepare_incidents
from areagrade.plans.requests import prepare_requests, request_profile, request_stats, request_totals
from areagrade.plans.scorecard import rated_scorecard, reports, scorecard
from areagrade.schemas import (
    AREA_VOLUME,
    EXPOSURE_NAMES,
    GAZETTEER,
    INCIDENT_NAMES,
    INCIDENTS,
    RATED_NAMES,
    REQUEST_NAMES,
    REQUEST_POSITIONS,
    TOTAL_NAMES,
    VOLUME_NAMES,
)
from areagrade.session import build_session, materialise
from areagrade.sources.sinks import ReportSet, write_ordered
from areagrade.sources.staged import stage_positions, stage_records

STATISTIC_NAMES = {"incident_stats": INCIDENT_NAMES, "request_stats": REQUEST_NAMES, "exposure": EXPOSURE_NAMES}


def write_area_volume(spark: SparkSession, counts_path: str, gazetteer_path: str, output: str) -> None:
    """Hourly segment counts and a street gazetteer to the (area, volume, samples) file.

    Each input is read and parsed once; the file and the rejects beside it appear together.
    """
    place = output.rstrip("/")
    with (
        stage_counts(spark, counts_path) as counts,
        stage_records(spark, gazetteer_path, GAZETTEER) as gazetteer,
        ReportSet(spark, f"{place}_manifest") as reports,
    ):
        volumes = area_volume(segment_names(counts.records), gazetteer.records)
        reports.write(renamed(volumes, VOLUME_NAMES), place)
        reports.write(counts.rejects(), f"{place}_count_rejects", fmt="text")
        reports.write(counts.rejects(TOO_LARGE), f"{place}_sum_rejects", fmt="text")
        reports.write(gazetteer.rejects(), f"{place}_gazetteer_rejects", fmt="text")


def run(
    spark: SparkSession, incidents_path: str, requests_path: str, volume_path: str, output: str | None = None
) -> DataFrame:
    """The rated scorecard; with ``output``, every statistic and report is also written there.

    Each input is read and parsed once, for the statistics and the rejects. The reports appear
    together: their manifest, beside ``output``, is written last.
    """
    with (
        stage_records(spark, incidents_path, INCIDENTS) as incidents,
        stage_positions(spark, requests_path, REQUEST_POSITIONS) as requests,
        stage_records(spark, volume_path, AREA_VOLUME) as volumes,
    ):
        exposure = annual_exposure(volumes.records)
        by_incident = incident_profile(prepare_incidents(incidents.records))
        by_request = request_profile(prepare_requests(requests.records))
        if output is None:
            return rated_scorecard(materialise(scorecard(exposure, incident_stats(by_incident), request_stats(by_request))))
        with ReportSet(spark, f"{output.rstrip('/')}_manifest") as written:
            rated = _write_statistics(materialise(by_incident), materialise(by_request), exposure, output.rstrip("/"), written)
            for name, staged in {"incident": incidents, "request": requests, "volume": volumes}.items():
                written.write(staged.rejects(), f"{output.rstrip('/')}/{name}_rejects", fmt="text")
        return rated


def _write_statistics(by_incident: DataFrame, by_request: DataFrame, exposure: DataFrame, output: str, written: ReportSet) -> DataFrame:
    """All statistics and reports of the two profiles; returns the rated scorecard."""
    statistics = {
        "incident_stats": incident_stats(by_incident),
        "request_stats": request_stats(by_request),
        "exposure": exposure,
    }
    statistics = {name: materialise(df) for name, df in statistics.items()}
    card = materialise(scorecard(statistics["exposure"], statistics["incident_stats"], statistics["request_stats"]))
    rated = rated_scorecard(card)
    for name, df in statistics.items():
        written.write(renamed(df, STATISTIC_NAMES[name]), f"{output}/{name}")
    # Categories are free text, so a list of all of them has any length.
    by_count = [F.desc(TOTAL_NAMES["n"]), TOTAL_NAMES["kind"], TOTAL_NAMES["category"]]
    for name, totals in {"incident_totals": incident_totals(by_incident), "request_totals": request_totals(by_request)}.items():
        write_ordered(renamed(totals, TOTAL_NAMES), written.path(f"{output}/{name}"), by_count)
    for name, df in reports(card).items():
        written.write(df, f"{output}/{name}", fmt="json", single=True)
    written.write(renamed(rated, RATED_NAMES), f"{output}/rated_scorecard")
    return rated


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="areagrade", description="Rate areas by road risk.")
    commands = parser.add_subparsers(dest="command", required=True)
    rate = commands.add_parser("rate", help="incidents, requests and area volumes to rated areas")
    for name in ("incidents", "requests", "volumes", "output"):
        rate.add_argument(name)
    volume = commands.add_parser("volume", help="segment counts and a gazetteer to area volumes")
    for name in ("counts", "gazetteer", "output"):
        volume.add_argument(name)
    args = parser.parse_args(arguments)
    spark = build_session()
    if args.command == "rate":
        run(spark, args.incidents, args.requests, args.volumes, args.output)
    else:
        write_area_volume(spark, args.counts, args.gazetteer, args.output)


if __name__ == "__main__":
    main()
