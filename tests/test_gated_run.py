"""The evidence run over gated sources."""

from __future__ import annotations

from conftest import SF
from probatio.plans import evidence_run
from probatio.plans.probe import PROFILE


def test_gated_run_reads_relevant_sources_only(spark):
    gated, run = evidence_run.gated_tables(spark, SF, PROFILE, 2024)
    status = {(r.package_id, r.source_ref): (r.relevance_status, len(r.body))
              for r in gated.collect()}
    relevant = {k for k, (s, _) in status.items() if s == "RELEVANT"}
    assert relevant and len(relevant) < len(status)
    assert relevant != {k for k, (_, length) in status.items() if length > 1500}
    cut = {(r.package_id, r.source_ref) for r in run.passages.collect()}
    said = {(r.package_id, r.source_ref) for r in run.evaluated.collect()}
    assert said and len({k[0] for k in said}) > 1 and said <= cut <= relevant
    home = {ref: package for package, ref in status}
    assert all(home[r.source_ref] == r.package_id for r in run.references.collect())


def test_only_relevant_texts_are_stored(spark):
    labels, _ = evidence_run.gated_labels(spark, SF, PROFILE, 2024)
    kept = {(r.package_id, r.source_ref): r.body for r in labels.collect()}
    gated, _ = evidence_run.gated_tables(spark, SF, PROFILE, 2024)
    rows = gated.collect()
    assert len(rows) == len(kept) and any(body is None for body in kept.values())
    assert all(kept[r.package_id, r.source_ref] == (
        r.body if r.relevance_status == "RELEVANT" else None) for r in rows)
