"""The experiment registry: what was planned, which dates it saw, how it ended. A control plane in SQLite."""

from __future__ import annotations

import json
import re
import sqlite3
import uuid
from contextlib import contextmanager

# What identifies a final evaluation.
IDENTITY = (
    "study", "hypothesis", "dataset_version", "universe_id", "panel_sha256", "config_sha256", "source_sha256",
    "target", "features", "development_start", "development_end", "locked_start", "locked_end",
)
_DATES = IDENTITY[-4:]
_SCHEMA = """
CREATE TABLE IF NOT EXISTS runs (id TEXT PRIMARY KEY, study TEXT NOT NULL, hypothesis TEXT NOT NULL, phase TEXT NOT NULL, status TEXT NOT NULL, manifest TEXT, result TEXT, error TEXT);
CREATE TABLE IF NOT EXISTS exposures (run TEXT NOT NULL REFERENCES runs(id), study TEXT NOT NULL, kind TEXT NOT NULL, begins TEXT NOT NULL, ends TEXT NOT NULL);
"""


class RegistryError(RuntimeError):
    pass


class ExperimentRegistry:
    def __init__(self, path: str):
        self.path = path
        with self._open() as db:
            db.executescript(_SCHEMA)

    @contextmanager
    def _open(self, write: bool = False):
        db = sqlite3.connect(self.path, isolation_level=None, timeout=30)
        try:
            if write:
                db.execute("BEGIN IMMEDIATE")
            yield db
            if write:
                db.execute("COMMIT")
        except BaseException:
            if write and db.in_transaction:
                db.execute("ROLLBACK")
            raise
        finally:
            db.close()

    def start(self, study: str, hypothesis: str, phase: str = "development") -> str:
        """A new running entry; a study keeps its first hypothesis."""
        with self._open(write=True) as db:
            known = db.execute("SELECT hypothesis FROM runs WHERE study = ? LIMIT 1", (study,)).fetchone()
            if known and known[0] != hypothesis:
                raise RegistryError("a study's hypothesis is fixed by its first run")
            run = uuid.uuid4().hex
            db.execute("INSERT INTO runs (id, study, hypothesis, phase, status) VALUES (?, ?, ?, ?, 'running')", (run, study, hypothesis, phase))
        return run

    def record_plan(self, run: str, manifest: dict) -> None:
        """Keep the manifest and expose the development dates, before anything is fitted."""
        check_manifest(manifest)
        with self._open(write=True) as db:
            self._running(db, run)
            db.execute("UPDATE runs SET manifest = ? WHERE id = ?", (json.dumps(manifest, sort_keys=True), run))
            self._expose(db, run, manifest["study"], "development", manifest["development_start"], manifest["development_end"])

    def reserve_final(self, run: str, manifest: dict) -> None:
        """Expose the locked dates for good, if a completed development run has the same identity and no earlier exposure meets them."""
        check_manifest(manifest)
        with self._open(write=True) as db:
            self._running(db, run)
            done = [json.loads(m) for (m,) in db.execute("SELECT manifest FROM runs WHERE study = ? AND phase = 'development' AND status = 'complete' AND manifest IS NOT NULL", (manifest["study"],))]
            if not any(all(d[k] == manifest[k] for k in IDENTITY) for d in done):
                raise RegistryError("no completed development run has this identity")
            met = db.execute("SELECT count(*) FROM exposures WHERE begins <= ? AND ends >= ?", (manifest["locked_end"], manifest["locked_start"])).fetchone()[0]
            if met:
                raise RegistryError("the locked dates were exposed before")
            self._expose(db, run, manifest["study"], "final", manifest["locked_start"], manifest["locked_end"])

    def complete(self, run: str, result: dict) -> None:
        self._end(run, "complete", "result", json.dumps(result, sort_keys=True))

    def fail(self, run: str, error: str) -> None:
        self._end(run, "failed", "error", error)

    def runs(self) -> list[dict]:
        with self._open() as db:
            names = ("id", "study", "hypothesis", "phase", "status")
            return [dict(zip(names, r, strict=True)) for r in db.execute(f"SELECT {', '.join(names)} FROM runs ORDER BY rowid")]

    def records(self) -> list[dict]:
        """Every entry with its manifest, result and error."""
        with self._open() as db:
            names = ("id", "study", "hypothesis", "phase", "status", "manifest", "result", "error")
            rows = [dict(zip(names, r, strict=True)) for r in db.execute(f"SELECT {', '.join(names)} FROM runs ORDER BY rowid")]
        return [r | {k: json.loads(r[k]) if r[k] else None for k in ("manifest", "result")} for r in rows]

    def _end(self, run: str, status: str, column: str, value: str) -> None:
        with self._open(write=True) as db:
            self._running(db, run)
            db.execute(f"UPDATE runs SET status = ?, {column} = ? WHERE id = ?", (status, value, run))

    @staticmethod
    def _running(db, run: str) -> None:
        row = db.execute("SELECT status FROM runs WHERE id = ?", (run,)).fetchone()
        if row is None or row[0] != "running":
            raise RegistryError("no such running entry")

    @staticmethod
    def _expose(db, run, study, kind, begins, ends) -> None:
        db.execute("INSERT INTO exposures VALUES (?, ?, ?, ?, ?)", (run, study, kind, begins, ends))


def check_manifest(manifest: dict) -> None:
    """All identity keys, ISO dates, and boundaries in order."""
    if missing := [k for k in IDENTITY if k not in manifest]:
        raise RegistryError(f"manifest lacks {missing}")
    dates = [manifest[k] for k in _DATES]
    if any(not re.fullmatch(r"\d{4}-\d{2}-\d{2}", d) for d in dates) or not dates[0] <= dates[1] < dates[2] <= dates[3]:
        raise RegistryError("boundaries must be ISO dates in order")
    if any(not re.fullmatch(r"[0-9a-f]{64}", manifest[k]) for k in IDENTITY if k.endswith("_sha256")):
        raise RegistryError("digests must be 64 hexadecimal digits")
