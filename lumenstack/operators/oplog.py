"""The annotation log: ordered fold of operation envelopes, and list saves as minimal operations (ST-8 to ST-16).

A store is folded in one place, since a batch may touch any of its records; stores (sessions) are the
unit of parallelism. Envelopes of a store are sorted before the fold and read as a stream; what is held
is the store's state, not its log.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CELLS = 1 << 20


class Refused(Exception):
    """An operation that refuses its envelope: `conflict` (with the current revision, or None) or `invalid`."""

    def __init__(self, kind: str, code: str, rev: int | None = None):
        super().__init__(code)
        self.kind, self.code, self.rev = kind, code, rev


class Store:
    """Records, labels and layers by id; each {rev, deleted, ...content}. Deleted ones are kept as tombstones."""

    def __init__(self, default_layer: str = "default"):
        self.tables: dict[str, dict[str, dict]] = {"annotation": {}, "label": {}, "layer": {default_layer: {"rev": 1, "deleted": False}}}
        self.default_layer = default_layer
        self.results: dict[str, dict] = {}
        self.undo: list[Callable[[], None]] = []
        self.revision = 0

    def run(self, op_id: str, op: dict) -> dict:
        """Apply an envelope: all of its operations or none. The same op_id gives the same result again."""
        if op_id in self.results:
            return self.results[op_id]
        self.undo, revs = [], {}
        try:
            for one in op["ops"] if op["type"] == "batch" else [op]:
                kind, key, rev = self.apply(one)
                revs[f"{kind}:{key}"] = rev
        except Refused as e:
            for back in reversed(self.undo):
                back()
            return {"result": e.kind, "code": e.code, "rev": e.rev, "revs": {}}
        self.revision += 1
        self.results[op_id] = {"result": "ok", "code": None, "rev": None, "revs": revs}
        return self.results[op_id]

    def _put(self, kind: str, key: str, entry: dict) -> None:
        table, old = self.tables[kind], self.tables[kind].get(key)
        self.undo.append(lambda: table.pop(key) if old is None else table.__setitem__(key, old))
        table[key] = entry

    def _target(self, kind: str, key: str, base: int, deleted: bool = False) -> dict:
        entry = self.tables[kind].get(key)
        if entry is None:
            raise Refused("conflict", "missing")
        if deleted and not entry["deleted"]:
            raise Refused("conflict", "current", entry["rev"])
        if (entry["deleted"] and not deleted) or (deleted and entry["rev"] != base):
            raise Refused("conflict", "deleted", entry["rev"])
        if entry["rev"] != base:
            raise Refused("conflict", "current", entry["rev"])
        return entry

    def _layer(self, key: str) -> None:
        if self.tables["layer"].get(key, {"deleted": True})["deleted"]:
            raise Refused("invalid", "unknown_layer")

    def _held(self, layer: str) -> bool:
        return any(not e["deleted"] and e.get("layer") == layer for kind in ("annotation", "label") for e in self.tables[kind].values())

    def apply(self, op: dict) -> tuple[str, str, int]:
        kind = op["type"]
        verb, _, what = kind.partition("_")
        if kind == "mask_tiles":
            return self.mask_tiles(op)
        if kind == "set_label":
            return self.set_label(op)
        if verb == "create":
            content = op[what]
            if content["id"] in self.tables[what]:
                raise Refused("invalid", "duplicate_id")
            if what == "annotation":
                self._layer(content["layer"])
            self._put(what, content["id"], {**content, "rev": 1, "deleted": False})
            return what, content["id"], 1
        entry = self._target(what, op["id"], op["base_rev"], deleted=verb == "restore")
        file = op.get("file") or (op.get("snapshot") or {}).get("file")
        if what == "annotation" and file != entry.get("file"):
            raise Refused("conflict", "deleted" if verb == "restore" else "current", entry["rev"])
        new = {**entry, "rev": entry["rev"] + 1}
        if verb == "update":
            if "layer" in op["after"]:
                self._layer(op["after"]["layer"])
            new |= op["after"]
        elif verb == "restore":
            self._layer(entry["layer"])
            new["deleted"] = False
        else:
            if what == "layer" and (op["id"] == self.default_layer or self._held(op["id"])):
                raise Refused("invalid", "bad_layer")
            new["deleted"] = True
        self._put(what, op["id"], new)
        return what, op["id"], new["rev"]

    def mask_tiles(self, op: dict) -> tuple[str, str, int]:
        entry = self._target("annotation", op["id"], op["base_rev"])
        if op["file"] != entry.get("file"):
            raise Refused("conflict", "current", entry["rev"])
        if entry.get("geometry", {}).get("type") != "mask":
            raise Refused("invalid", "geometry_not_allowed")
        frames = {k: dict(v) for k, v in entry["geometry"].get("frames", {}).items()}
        tiles = frames.setdefault(str(op["frame"]), {})
        for t in op["tiles"]:
            at = f"{t['column']},{t['row']}"
            if t.get("after") is None:
                tiles.pop(at, None)
            else:
                tiles[at] = t["after"]
        if not tiles:
            del frames[str(op["frame"])]
        new = {**entry, "rev": entry["rev"] + 1, "geometry": {**entry["geometry"], "frames": frames}, "frames": sorted(map(int, frames))}
        self._put("annotation", op["id"], new)
        return "annotation", op["id"], new["rev"]

    def set_label(self, op: dict) -> tuple[str, str, int]:
        place = {k: op[k] for k in ("target", "field", "layer")}
        if op.get("base_rev") is None:
            if op["id"] in self.tables["label"]:
                raise Refused("invalid", "duplicate_id")
            if op.get("after") is None:
                raise Refused("invalid", "empty_patch")
            self._layer(op["layer"])
            author = op.get("author")
            if any(all(e[k] == place[k] for k in place) and e.get("author") == author for e in self.tables["label"].values()):
                raise Refused("invalid", "duplicate_label")
            self._put("label", op["id"], {**place, "author": author, "value": op["after"], "rev": 1, "deleted": False})
            return "label", op["id"], 1
        entry = self.tables["label"].get(op["id"])
        if entry is None:
            raise Refused("conflict", "missing")
        if entry["rev"] != op["base_rev"] or any(entry[k] != place[k] for k in place):
            raise Refused("conflict", "deleted" if entry["deleted"] else "current", entry["rev"])
        if op.get("after") is not None:
            self._layer(op["layer"])
        self._put("label", op["id"], {**entry, "value": op.get("after"), "deleted": op.get("after") is None, "rev": entry["rev"] + 1})
        return "label", op["id"], entry["rev"] + 1


def _sorted_fold(ops: DataFrame, run: Callable, schema: str) -> DataFrame:
    """mapInPandas over envelopes, each store in one partition, in order."""
    rows = ops.select("store", "seq", "op_id", "op").repartition("store").sortWithinPartitions("store", "seq")
    return rows.mapInPandas(run, schema)


def op_results(ops: DataFrame) -> DataFrame:
    """(store, seq, op_id, result, code, rev): the outcome of every envelope (store, seq, op_id, op as JSON)."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, store = None, Store()
        for batch in batches:
            out = []
            for key, seq, op_id, op in batch.itertuples(index=False):
                if key != name:
                    name, store = key, Store()
                r = store.run(op_id, json.loads(op))
                out.append((key, seq, op_id, r["result"], r["code"], r["rev"]))
            yield pd.DataFrame(out, columns=["store", "seq", "op_id", "result", "code", "rev"]).astype({"rev": "Int64"})

    return _sorted_fold(ops, run, "store string, seq bigint, op_id string, result string, code string, rev bigint")


def folded_state(ops: DataFrame) -> DataFrame:
    """(store, kind, id, rev, deleted, record as JSON): the state that all envelopes leave."""

    def rows(name: str, store: Store) -> pd.DataFrame:
        out = [(name, kind, key, e["rev"], e["deleted"], json.dumps(e, sort_keys=True)) for kind, table in store.tables.items() for key, e in table.items()]
        return pd.DataFrame(out, columns=["store", "kind", "id", "rev", "deleted", "record"])

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, store = None, Store()
        for batch in batches:
            for key, _, op_id, op in batch.itertuples(index=False):
                if key != name:
                    if name is not None:
                        yield rows(name, store)
                    name, store = key, Store()
                store.run(op_id, json.loads(op))
        if name is not None:
            yield rows(name, store)

    return _sorted_fold(ops, run, "store string, kind string, id string, rev bigint, deleted boolean, record string")


def _chosen(old: np.ndarray, new: np.ndarray, leave: bool) -> list[int]:
    """The old item that becomes each leading new one, ascending: most equal, then most items, then the earliest.

    With `leave`, new items may be left over; without, all of them get an old one.
    """
    worth = len(new) + 1  # of an equal item, more than all places together
    # row j: what the new items from j on are worth at best if the old items from a column on are free
    best = np.full((len(new) + 1, len(old) + 1), 0 if leave else -(worth**2) * 2, np.int64)
    best[-1] = 0
    gain = lambda j, at: best[j + 1, at + 1 :] + 1 + worth * (old[at:] == new[j])
    for j in range(len(new) - 1, -1, -1):
        best[j, :-1] = np.maximum(np.maximum.accumulate(gain(j, 0)[::-1])[::-1], best[j, -1])
    found: list[int] = []
    for j in range(len(new)):
        at = found[-1] + 1 if found else 0
        if at == len(old):
            break
        found.append(at + int(gain(j, at).argmax()))
    return found


def pairing(had: list, wanted: list, cells: int = MAX_CELLS) -> list[int | None]:
    """For each old item the new one it becomes, in order, or None.

    The most items that stay equal, then the most pairs, then earlier items first; new items without an
    old one must come last. The equal run at the start is paired first; where the rest has more than
    `cells` combinations, the equal run at the end too, and then the middle without new items or by place.
    """
    codes = {x: k for k, x in enumerate(dict.fromkeys([*had, *wanted]))}
    old, new = (np.array([codes[x] for x in xs], np.int64) for xs in (had, wanted))
    run = lambda a, b: int(np.append(a[: len(b)] != b[: len(a)], True).argmax())
    head = run(old, new)
    became: dict[int, int] = {k: k for k in range(head)}
    old, new = old[head:], new[head:]
    tail = 0
    if (len(old) + 1) * (len(new) + 1) > cells and len(new) <= len(old):
        tail = run(old[::-1], new[::-1])
        became |= {len(had) - 1 - k: len(wanted) - 1 - k for k in range(tail)}
        old, new = old[: len(old) - tail], new[: len(new) - tail]
    if (len(old) + 1) * (len(new) + 1) <= cells:
        places = _chosen(old, new, leave=not tail)
    else:
        places = range(min(len(old), len(new)))
    became |= {head + i: head + j for j, i in enumerate(places)}
    return [became.get(i) for i in range(len(had))]


def replacement_ops(lists: DataFrame) -> DataFrame:
    """(file, step, op, old, new): updates, then deletes, then creates that turn `had` into `wanted` (arrays of strings).

    A list is one row, so a file's save is one task's work whatever the number of files.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for file, had, wanted in batch.itertuples(index=False):
                had, wanted = list(had), list(wanted)
                given = pairing(had, wanted)
                ops = [("update", i, j) for i, j in enumerate(given) if j is not None and had[i] != wanted[j]]
                ops += [("delete", i, None) for i, j in enumerate(given) if j is None]
                taken = set(given)
                ops += [("create", None, j) for j in range(len(wanted)) if j not in taken]
                out += [(file, step, op, None if i is None else had[i], None if j is None else wanted[j]) for step, (op, i, j) in enumerate(ops)]
            yield pd.DataFrame(out, columns=["file", "step", "op", "old", "new"])

    return lists.select(F.col("file").cast("string").alias("file"), "had", "wanted").mapInPandas(run, "file string, step int, op string, old string, new string")


def staged_and_edited(staged: DataFrame, edited: DataFrame, key: str = "file_index") -> DataFrame:
    """Rows in force: an edit wins over a late import; files without a box are not staged (ST-16)."""
    own = staged.where(F.size("roi_coords") > 0).join(edited.select(key).distinct(), key, "left_anti")
    return own.withColumn("source", F.lit("import")).unionByName(edited.withColumn("source", F.lit("edit")))


def snapshot(records: DataFrame, files: DataFrame, key: str = "file_key") -> DataFrame:
    """Live records of a set of files (ST-17)."""
    return records.where(~F.col("deleted")).join(files.select(key).distinct(), key, "left_semi")
