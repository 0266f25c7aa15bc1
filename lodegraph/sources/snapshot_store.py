"""Snapshots of a graph on a file system: publish, read, pin, prune, export.

Layout: ``<root>/current`` names a directory in ``<root>/snapshots/``.  A snapshot holds one Parquet
directory per table and ``manifest.json``.  Writers stage under a dotted name, take the advisory lock
``<root>/.lock`` and rename; readers resolve the id once and never see half a snapshot.

Plans are pure descriptions with a revision, the SHA-256 of their canonical JSON.  Applying one needs the
revision it was made with (compare and swap): if the graph has moved on, nothing is touched.  The tables
go through Spark; only names, locks and manifests are handled here.
"""

from __future__ import annotations

import contextlib
import fcntl
import hashlib
import json
import os
import re
import shutil
import uuid
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from lodegraph.tables import SCHEMAS, GraphTables, empty

REQUIRED = ("entities", "relationships", "text_units")
SCHEMA_VERSION = 1
_STAGING = re.compile(r"^\.staging-[0-9a-f]{32}$")
_REVISION = re.compile(r"^sha256:[0-9a-f]{64}$")


class SnapshotError(ValueError):
    """A reference, a layout or an expected revision does not hold."""


def is_published_id(name: str) -> bool:
    return bool(name.strip()) and not name.startswith(".") and not re.search(r"[/\\\s\0]", name)


def parse_ref(ref: str | None) -> str | None:
    """None, ``current``, or a published id; everything else is an error."""
    if ref is None or ref == "current":
        return ref
    if not isinstance(ref, str) or not is_published_id(ref):
        raise SnapshotError(f"not a snapshot reference: {ref!r}")
    return ref


def canonical(value) -> str:
    """JSON with sorted keys and no blanks; infinite and NaN numbers are errors."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def revision_of(value) -> str:
    return "sha256:" + hashlib.sha256(canonical(value).encode()).hexdigest()


def expect_revision(given: str, plan: dict) -> None:
    if not _REVISION.match(given or ""):
        raise SnapshotError("a revision is sha256: and 64 hex digits")
    if given != plan["revision"]:
        raise SnapshotError("the graph has changed since the plan was made")


def _write_text(path: Path, text: str) -> None:
    temp = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    with temp.open("w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(temp, path)


class SnapshotStore:
    def __init__(self, spark: SparkSession | None, root: str | Path):
        self.spark = spark
        self.root = self._graph_base(Path(root))

    @staticmethod
    def _graph_base(root: Path) -> Path:
        """The root itself, or its ``output`` folder if only that holds a graph."""
        inner = root / "output"
        holds = lambda p: (p / "snapshots").is_dir() or (p / "entities.parquet").exists()
        return inner if not holds(root) and holds(inner) else root

    @property
    def snapshots(self) -> Path:
        return self.root / "snapshots"

    @contextlib.contextmanager
    def lock(self, exclusive: bool, create: bool = True):
        path = self.root / ".lock"
        if not path.exists() and not create:
            raise SnapshotError("the graph has no lock file; adopt one first")
        self.root.mkdir(parents=True, exist_ok=True)
        with path.open("a") as f:
            fcntl.flock(f, fcntl.LOCK_EX if exclusive else fcntl.LOCK_SH)
            yield

    def adopt_lock(self) -> bool:
        """Create the lock file of an older graph; False if it is there."""
        if not self.root.is_dir():
            raise SnapshotError("no such graph")
        path = self.root / ".lock"
        made = not path.exists()
        path.touch()
        return made

    # reading
    def ids(self) -> list[str]:
        if not self.snapshots.is_dir():
            return []
        return sorted((p.name for p in self.snapshots.iterdir() if p.is_dir() and is_published_id(p.name)), key=lambda s: s.encode())

    def current(self) -> str | None:
        path = self.root / "current"
        name = path.read_text().strip() if path.exists() else ""
        return name if name in self.ids() else None

    def resolve(self, ref: str | None = None) -> Path:
        """Directory of a reference; a flat graph without snapshots is its own."""
        ref = parse_ref(ref)
        if ref in (None, "current"):
            now = self.current()
            if now:
                return self.snapshots / now
            if (self.root / "entities.parquet").exists():
                return self.root
            raise SnapshotError("the graph has no current snapshot")
        if ref not in self.ids():
            raise SnapshotError(f"no snapshot {ref!r}")
        return self.snapshots / ref

    def tables(self, ref: str | None = None) -> GraphTables:
        base = self.resolve(ref)
        out = {}
        for name, schema in SCHEMAS.items():
            path = base / f"{name}.parquet"
            if path.exists():
                out[name] = self.spark.read.schema(schema).parquet(str(path))
            elif name in ("text_units", "call_observations"):
                out[name] = empty(self.spark, name)
            else:
                raise SnapshotError(f"{name} is missing in {base.name}")
        return GraphTables(**out)

    def manifest(self, ref: str | None = None) -> dict:
        path = self.resolve(ref) / "manifest.json"
        return json.loads(path.read_text()) if path.exists() else {}

    def status(self) -> dict:
        return {"current": self.current(), "snapshots": self.ids(), "pins": self.pins()["pins"], "manifest": self.manifest() if self.current() else {}}

    def history(self, limit: int = 20) -> dict:
        ids = self.ids()[::-1]
        n = min(max(0, limit), 200)
        return {"total": len(ids), "returned": min(n, len(ids)), "truncated": len(ids) > n, "snapshots": [self.manifest(i) | {"id": i} for i in ids[:n]]}

    # writing
    def publish(self, tables: GraphTables, keep_last: int = 5, extra: dict | None = None) -> str:
        """Write a snapshot, make it current, and drop what retention no longer keeps."""
        self.snapshots.mkdir(parents=True, exist_ok=True)
        stage = self.snapshots / f".staging-{uuid.uuid4().hex}"
        stage.mkdir()
        lease = (stage / ".writer").open("w")
        fcntl.flock(lease, fcntl.LOCK_EX)
        try:
            counts, files = {}, []
            for name, df in tables.named().items():
                path = stage / f"{name}.parquet"
                df.write.parquet(str(path))
                counts[name] = self.spark.read.parquet(str(path)).count()
                if name == "call_observations" and not counts[name]:
                    shutil.rmtree(path)
                    continue
                files.append(f"{name}.parquet")
            now = datetime.now(timezone.utc)
            size = sum(p.stat().st_size for p in stage.rglob("*.parquet") if p.is_file())
            with self.lock(exclusive=True):
                name = now.strftime("%Y%m%d-%H%M%S-") + uuid.uuid4().hex[:8]
                core = {
                    "id": name, "created_at": now.replace(tzinfo=None).isoformat(), "schema_version": SCHEMA_VERSION, "counts": counts, "files": files,
                    "source_root": None, "git_commit": None, "total_size_bytes": size, "corpus_hash": None,
                }
                _write_text(stage / "manifest.json", canonical((extra or {}) | core))
                (stage / ".writer").unlink()
                os.rename(stage, self.snapshots / name)
                _write_text(self.root / "current", name)
                plan = self.retention_plan(keep_last)
                for old in plan["delete"]:
                    shutil.rmtree(self.snapshots / old)
            return name
        except BaseException:
            shutil.rmtree(stage, ignore_errors=True)
            raise
        finally:
            lease.close()

    def activate(self, ref: str, expected_current: str | None) -> str:
        """Point ``current`` elsewhere, if it still points where the caller believes."""
        with self.lock(exclusive=True, create=False):
            if self.current() != expected_current:
                raise SnapshotError("current has moved")
            name = self.resolve(ref).name
            _write_text(self.root / "current", name)
            return name

    # pins
    def pins(self) -> dict:
        path = self.root / "pins.json"
        pins = json.loads(path.read_text())["pins"] if path.exists() else []
        return {"pins": pins, "revision": revision_of({"pins": pins})}

    def _change_pins(self, expected: str, change) -> dict:
        with self.lock(exclusive=True, create=False):
            now = self.pins()
            expect_revision(expected, now)
            pins = sorted(change(set(now["pins"])), key=lambda s: s.encode())
            _write_text(self.root / "pins.json", canonical({"pins": pins}))
            return self.pins()

    def pin(self, name: str, expected: str) -> dict:
        if name not in self.ids():
            raise SnapshotError(f"no snapshot {name!r}")
        return self._change_pins(expected, lambda p: p | {name})

    def unpin(self, name: str, expected: str) -> dict:
        return self._change_pins(expected, lambda p: p - {name})

    # retention
    def retention_plan(self, keep_last: int = 5) -> dict:
        """Current and existing pins stay; the newest others fill up to ``keep_last`` (at least 1)."""
        ids, now, pins = self.ids(), self.current(), set(self.pins()["pins"])
        if ids and now is None:
            raise SnapshotError("snapshots without a current one")
        safe = ({now} if now else set()) | (pins & set(ids))
        slots = max(0, max(1, keep_last) - len(safe))
        others = [i for i in ids if i not in safe]
        kept = safe | set(others[len(others) - slots :] if slots else [])
        plan = {
            "keep_last": max(1, keep_last), "current": now, "published": ids, "pins": sorted(pins & set(ids)), "dangling_pins": sorted(pins - set(ids)),
            "retained": [i for i in ids if i in kept], "delete": [i for i in ids if i not in kept],
        }
        return plan | {"revision": revision_of(plan)}

    def prune(self, keep_last: int, expected: str) -> dict:
        """Delete what the plan says, in byte order; on a failure say what is left to do."""
        with self.lock(exclusive=True, create=False):
            plan = self.retention_plan(keep_last)
            expect_revision(expected, plan)
            if set(plan["delete"]) & ({plan["current"]} | set(plan["pins"]) | set(plan["retained"])):
                raise SnapshotError("the plan would delete a protected snapshot")
            done: list[str] = []
            for i, name in enumerate(plan["delete"]):
                try:
                    shutil.rmtree(self.snapshots / name)
                except OSError:
                    return {"deleted_snapshots": done, "failed_snapshot": name, "not_attempted_snapshots": plan["delete"][i + 1 :]}
                done.append(name)
            return {"deleted_snapshots": done, "failed_snapshot": None, "not_attempted_snapshots": []}

    # staging
    def staging(self) -> dict:
        """Left-over staging directories: removable ones have a canonical name and a free writer lock."""
        rows = []
        for p in sorted(self.snapshots.glob(".staging*")) if self.snapshots.is_dir() else []:
            reason = None
            if p.is_symlink() or not p.is_dir():
                reason = "not_a_directory"
            elif not _STAGING.match(p.name):
                reason = "name"
            elif not (p / ".writer").is_file():
                reason = "no_writer_lock"
            else:
                with (p / ".writer").open("a") as f:
                    try:
                        fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                    except OSError:
                        reason = "held"
            rows.append({"name": p.name, "removable": reason is None, "reason": reason})
        return {"staging": rows, "revision": revision_of(rows)}

    def clean_staging(self, expected: str) -> list[str]:
        with self.lock(exclusive=True, create=False):
            found = self.staging()
            expect_revision(expected, found)
            gone = [r["name"] for r in found["staging"] if r["removable"]]
            for name in gone:
                shutil.rmtree(self.snapshots / name)
            return gone

    # maintenance: retention and staging in one revision
    def maintenance_plan(self, keep_last: int = 5) -> dict:
        parts = {"retention": self.retention_plan(keep_last), "staging": self.staging()}
        return parts | {"revision": revision_of({k: v["revision"] for k, v in parts.items()})}

    def maintenance_apply(self, keep_last: int, expected: str) -> dict:
        plan = self.maintenance_plan(keep_last)
        expect_revision(expected, plan)
        pruned = self.prune(keep_last, plan["retention"]["revision"])
        cleaned = [] if pruned["failed_snapshot"] else self.clean_staging(plan["staging"]["revision"])
        return pruned | {"cleaned_staging": cleaned}

    def maintenance_reconcile(self, plan: dict) -> dict:
        """A plan against the graph as it is: what is done, what is still to do, what came since."""
        ids, stages = set(self.ids()), {r["name"] for r in self.staging()["staging"]}
        meant = plan["retention"]["delete"]
        known = set(plan["retention"]["published"])
        return {
            "done": [i for i in meant if i not in ids], "open": [i for i in meant if i in ids], "lost": [i for i in plan["retention"]["retained"] if i not in ids],
            "new": sorted(ids - known), "staging_open": [r["name"] for r in plan["staging"]["staging"] if r["removable"] and r["name"] in stages],
        }

    # export
    def export_plan(self, ref: str | None = None) -> dict:
        """Every file of a snapshot with size and SHA-256, read in pieces, twice, to see it does not move."""
        base = self.resolve(ref)
        first, second = self._inventory(base), self._inventory(base)
        if first != second:
            raise SnapshotError("the snapshot changed while it was read")
        plan = {"snapshot": base.name, "files": first}
        return plan | {"revision": revision_of(plan)}

    @staticmethod
    def _inventory(base: Path) -> list[dict]:
        out = []
        for p in sorted(base.rglob("*"), key=lambda p: str(p.relative_to(base)).encode()):
            if p.is_symlink():
                raise SnapshotError(f"{p.name} is a link")
            if p.is_file():
                digest = hashlib.sha256()
                with p.open("rb") as f:
                    while piece := f.read(1 << 20):
                        digest.update(piece)
                out.append({"path": str(p.relative_to(base)), "size": p.stat().st_size, "sha256": digest.hexdigest()})
        return out

    def export_apply(self, target: str | Path, expected: str, ref: str | None = None) -> str:
        """Copy a snapshot out: staged beside the target, verified, renamed; an existing target is an error."""
        target = Path(target)
        with self.lock(exclusive=False, create=False):
            plan = self.export_plan(ref)
            expect_revision(expected, plan)
            if target.exists():
                raise SnapshotError("the target exists")
            target.parent.mkdir(parents=True, exist_ok=True)
            stage = target.parent / f".export-{uuid.uuid4().hex}"
            try:
                shutil.copytree(self.resolve(ref), stage)
                if self._inventory(stage) != plan["files"]:
                    raise SnapshotError("the copy differs")
                os.rename(stage, target)
            finally:
                shutil.rmtree(stage, ignore_errors=True)
        return plan["revision"]

    def export_verify(self, target: str | Path, expected: str) -> bool:
        plan = {"snapshot": None, "files": self._inventory(Path(target))}
        manifest = json.loads((Path(target) / "manifest.json").read_text())
        plan["snapshot"] = manifest["id"]
        return revision_of(plan) == expected

    def export_reconcile(self, target: str | Path, ref: str | None = None) -> dict:
        """Files of the snapshot against a copy: missing, surplus, different."""
        want = {f["path"]: f for f in self.export_plan(ref)["files"]}
        have = {f["path"]: f for f in self._inventory(Path(target))} if Path(target).is_dir() else {}
        return {
            "missing": sorted(want.keys() - have.keys()), "extra": sorted(have.keys() - want.keys()),
            "different": sorted(p for p in want.keys() & have.keys() if want[p] != have[p]),
        }

    @staticmethod
    def export_staging(folder: str | Path) -> dict:
        rows = [{"name": p.name, "removable": p.is_dir() and not p.is_symlink()} for p in sorted(Path(folder).glob(".export-*"))]
        return {"staging": rows, "revision": revision_of(rows)}

    @classmethod
    def export_cleanup_plan(cls, folder: str | Path) -> dict:
        found = cls.export_staging(folder)
        plan = {"remove": [r["name"] for r in found["staging"] if r["removable"]], "inventory": found["revision"]}
        return plan | {"revision": revision_of(plan)}

    # reuse
    def reusable(self, fingerprint: str, options: dict) -> str | None:
        """The current snapshot, if it was built from the same input with the same options."""
        if not self.current():
            return None
        m = self.manifest()
        return self.current() if m.get("input_fingerprint") == fingerprint and m.get("options") == options else None


def tables_of(df_by_name: dict[str, DataFrame], spark: SparkSession) -> GraphTables:
    """Graph tables from what is there: list columns that are missing come as empty lists, tables as empty tables."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    out = {}
    for name, schema in SCHEMAS.items():
        df = df_by_name.get(name)
        if df is None:
            out[name] = empty(spark, name)
            continue
        for field in T._parse_datatype_string(schema).fields:
            if field.name not in df.columns:
                blank = F.array() if field.name in ("document_ids", "covariate_ids", "text_unit_ids") else F.lit(None)
                df = df.withColumn(field.name, blank.cast(field.dataType))
        out[name] = df.select(*[f.name for f in T._parse_datatype_string(schema).fields])
    return GraphTables(**out)


