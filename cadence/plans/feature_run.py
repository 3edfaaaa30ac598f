"""From a manifest to the assembled feature table, through the feature store (the reference's stages 2 to 4).

Transcripts are incremental: only clips that the stored transcripts lack are transcribed (JN2), rows that fail carry an
``error`` instead of being dropped, and a new version of the table is committed (S4). Feature views are all or nothing: a stored view is
reused only if its keys are exactly those of the transcripts (U4), else it is built anew. The views are joined onto the
transcripts' keys and labels (JN1).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.operators.assemble import assemble, feature_columns, view_columns
from cadence.operators.keys import dedupe_first, pending
from cadence.plans.scoring_run import ScoringResult, run_scoring
from cadence.schemas import KEY_COLUMNS
from cadence.sources.store import FeatureStore

TRANSCRIPTS = "transcripts"
Build = Callable[[DataFrame], DataFrame]


@dataclass
class FeatureTable:
    table: DataFrame                    # keys, label, every view's columns
    views: dict[str, list[str]]         # view name to its feature columns
    transcribed: int                    # clips that were not stored before

    @property
    def features(self) -> list[str]:
        return feature_columns(self.table)


def update_transcripts(store: FeatureStore, manifest: DataFrame, transcribe: Build, keys: Sequence[str] = KEY_COLUMNS) -> int:
    """Transcribe what ``manifest`` (keys, label) has and the store has not; returns how many clips that were.

    ``transcribe`` gets manifest rows and returns the keys with its columns, an ``error`` where a clip failed. Stored rows keep their values but take
    the manifest's label. A repeated key counts once, the first by its other columns' order."""
    keys = list(keys)
    clips = dedupe_first(manifest, keys, [c for c in manifest.columns if c not in keys])
    if not store.exists(TRANSCRIPTS):
        new = transcribe(clips)
        store.write(clips.join(new.drop(*[c for c in clips.columns if c not in keys]), keys), TRANSCRIPTS)
        return store.read(TRANSCRIPTS).count()
    stored = store.read(TRANSCRIPTS)
    todo = pending(clips, stored, keys).persist()
    try:
        n = todo.count()
        if n:
            new = todo.join(transcribe(todo).drop(*[c for c in clips.columns if c not in keys]), keys)
            store.write(stored.unionByName(new, allowMissingColumns=True), TRANSCRIPTS)
    finally:
        todo.unpersist()
    return n


def build_features(store: FeatureStore, manifest: DataFrame, transcribe: Build, views: Mapping[str, Build],
                   keys: Sequence[str] = KEY_COLUMNS, dedupe_after_join: bool = False) -> FeatureTable:
    """The feature table of all clips of ``manifest``. ``views`` map transcripts to (keys, features), one row per clip.

    ``dedupe_after_join`` keeps one row per key of the joined table too (the notebook does; the first by the other columns), for views
    that may repeat a key."""
    keys = list(keys)
    transcribed = update_transcripts(store, manifest, transcribe, keys)
    known = store.read(TRANSCRIPTS)
    transcripts = known.join(manifest.select(*keys).distinct(), keys, "left_semi")
    built = {name: store.get_or_build(name, transcripts.select(*keys), lambda build=build: build(transcripts)) for name, build in views.items()}
    spine = transcripts.select(*keys, "label")
    table = assemble(spine, list(built.values()), keys)
    if dedupe_after_join:
        table = dedupe_first(table, keys, [c for c in table.columns if c not in keys])
    features = feature_columns(table, [*keys, "label"])
    return FeatureTable(table, {name: view_columns(features, v) for name, v in built.items()}, transcribed)


def run_from_manifest(store: FeatureStore, manifest: DataFrame, transcribe: Build, views: Mapping[str, Build], embedding: str | None = None,
                      emb_dim: int = 0, key: str = "filename", keys: Sequence[str] = KEY_COLUMNS, **options) -> ScoringResult:
    """Manifest to checked predictions: the feature table, then :func:`run_scoring`. The view named ``embedding`` has the one column
    ``embedding`` and is not part of the handcrafted features."""
    built = build_features(store, manifest, transcribe, views, keys)
    numeric = {name: own for name, own in built.views.items() if name != embedding}
    features = [c for own in numeric.values() for c in own]
    return run_scoring(built.table, key, "label", features, numeric, "embedding" if embedding else None, emb_dim, **options)


def failed_clips(store: FeatureStore) -> DataFrame:
    """Stored transcripts that carry an ``error``."""
    known = store.read(TRANSCRIPTS)
    return known.where(F.col("error").isNotNull()) if "error" in known.columns else known.limit(0)
