"""What a dashboard shows of a run: assets, findings in report order, modules, and where they come from."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.errors import FindingError
from provena.functions.ids import ID_TYPE
from provena.operators import findings as fi
from provena.plans.runner import IntegrityRun

DEMO_MARK = "DEMO / SAMPLE DATA"  # fixed value
ASSET = f"image_id {ID_TYPE}, file_name string, file_path string, width int, height int"
FINDING = f"finding_id string, layer string, finding_type string, image_id {ID_TYPE}, image_ids array<{ID_TYPE}>, title string, severity string, score double, recommendation string, reason string, confidence double, source_detector string, reference string"
#: rows of a snapshot that one JSON text may hold; larger ones are written as lines
JSON_ROWS = 100_000


@dataclass
class Snapshot:
    run_id: str
    mode: str
    dataset_name: str
    assets: DataFrame  # image_id, file_name, file_path, width, height
    findings: DataFrame
    active_modules: tuple[str, ...]
    unavailable_modules: tuple[str, ...]
    demo_mark: str | None = None
    metadata: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.mode not in fi.MODES:
            raise FindingError("mode is demo or pipeline")
        if self.mode == "demo" and self.demo_mark != DEMO_MARK:
            raise FindingError("a demo is marked as such")
        if not self.run_id.strip():
            raise FindingError("run_id must not be empty")

    def report(self) -> DataFrame:
        """Findings in report order with their assets' paths."""
        return fi.ordered(fi.with_assets(self.findings, self.assets))

    def header(self) -> dict:
        return {
            "run_id": self.run_id,
            "schema_version": fi.SCHEMA_VERSION,
            "mode": self.mode,
            "dataset_name": self.dataset_name,
            "total_assets": self.assets.count(),
            "active_modules": list(self.active_modules),
            "unavailable_modules": list(self.unavailable_modules),
            "demo_mark": self.demo_mark,
            "metadata": self.metadata,
        }

    def to_json(self) -> str:
        """One JSON text with sorted keys and no NaN, for snapshots of at most ``JSON_ROWS`` assets and findings."""
        if self.assets.limit(JSON_ROWS + 1).count() + self.findings.limit(JSON_ROWS + 1).count() > JSON_ROWS:
            raise FindingError("the snapshot is too large for one text; write_lines() has no such bound")
        lines = fi.finding_json(fi.ordered(self.findings)).orderBy(F.get_json_object("json", "$.layer"), "finding_id").collect()
        assets = self.assets.orderBy("image_id").select(F.to_json(F.struct(*self.assets.columns), {"ignoreNullFields": "false"}).alias("json")).collect()
        parts = {"findings": [json.loads(r["json"]) for r in lines], "assets": [json.loads(r["json"]) for r in assets]}
        return json.dumps(self.header() | parts, sort_keys=True, indent=2, allow_nan=False)

    def write_lines(self, folder: str) -> None:
        """The same as JSON lines below ``folder``, written by all tasks: header, assets, findings."""
        spark = self.findings.sparkSession
        spark.createDataFrame([(json.dumps(self.header(), sort_keys=True, allow_nan=False),)], "value string").coalesce(1).write.text(f"{folder}/header")
        self.assets.write.json(f"{folder}/assets")
        fi.finding_json(self.findings).select("json").write.text(f"{folder}/findings")


def snapshot_of(run: IntegrityRun | None, spark: SparkSession, run_id: str = "", dataset_name: str = "", assets: DataFrame | None = None, metadata: dict | None = None) -> Snapshot:
    """Of a run; without one, an empty snapshot that says so."""
    if run is None or assets is None:
        waiting = {"status": "no run was supplied"}
        none = spark.createDataFrame([], ASSET), spark.createDataFrame([], FINDING)
        return Snapshot("pipeline-not-connected", "pipeline", "No pipeline run supplied", *none, (), ("Layer 1A-1H",), metadata=waiting)
    there = {"1C": run.near_duplicates, "1D": run.labels, "1E": run.shift, "1F": run.risk, "1G": run.hashes, "1H": run.silhouette}
    active = ("1A Dataset Parser", *(f"Layer {k}" for k, v in there.items() if v is not None))
    return Snapshot(run_id, "pipeline", dataset_name, assets, run.findings, active, tuple(f"Layer {k}" for k, v in there.items() if v is None), metadata=metadata or {})


# Fixed values of the demo: assets, and findings (layer, id, images, title, severity, confidence, score, recommendation).
DEMO_ASSETS = ("IMG-0441", "IMG-0442", "IMG-0443")
DEMO_FINDINGS = (
    ("1C", "demo-1c-pair-01", (0, 1), "Near-duplicate pair candidate", "warning", 0.91, 0.976, "REVIEW"),
    ("1D", "demo-1d-label-02", (1,), "Label-neighborhood review candidate", "warning", 0.78, 0.67, "REVIEW"),
    ("1E", "demo-1e-shift-03", (2,), "Reference distribution-shift candidate", "info", 0.62, 0.74, "REVIEW"),
    ("1G", "demo-1g-phash-04", (0, 1), "Perceptually similar image candidate", "warning", 0.88, 4.0, "QUARANTINE"),
)


def demo_snapshot(spark: SparkSession) -> Snapshot:
    """Three sample assets and four findings, marked as a demo."""
    ids = [("str", x) for x in DEMO_ASSETS]
    assets = spark.createDataFrame([(i, f"sample-asset-{k + 1}.png", None, 720, 420) for k, i in enumerate(ids)], ASSET)
    rows = []
    for layer, fid, at, title, severity, confidence, score, advice in DEMO_FINDINGS:
        detector, reference = fi.LAYERS[layer]
        rows.append((fid, layer, detector, ids[at[0]], [ids[k] for k in at], title, severity, score, advice, "sample finding", confidence, f"demo.{detector}", f"demo:{reference}"))
    active = ("1A Dataset Parser", "1B Features (sample)", "1C Cosine", "1D Labels", "1E OOD", "1G pHash")
    findings = spark.createDataFrame(rows, FINDING)
    return Snapshot("demo-run", "demo", "Demo sample", assets, findings, active, ("1F Provenance Aggregation", "1H Silhouette"), DEMO_MARK, {"synthetic": True})
