"""Tables of knowledge bases, kept in buckets of their key, changed bucket by bucket and published in one step."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .communities import StaleGraph
from .store import TABLES, Graph

#: Buckets of a new store: knowledge bases are dealt over them by a hash.
BUCKETS = 64
#: What a store holds beside the graph, and the tables of the graph with the knowledge base that they belong to.
DOCUMENTS = "kb_id long, doc_id long, title string, source string, metadata variant, index_version long, status string, reason string"
CHUNKS = "kb_id long, chunk_id long, doc_id long, position long, title string, content string, embedding array<double>"
SCHEMAS = {"documents": DOCUMENTS, "chunks": CHUNKS} | {name: schema if schema.startswith("kb_id") else f"kb_id long, {schema}" for name, schema in TABLES.items()}
#: Columns whose numbers are given by the store.
NUMBERED = {"entities": "entity_id", "relationships": "relationship_id", "communities": "community_id"}
DATA, STATES = "data", "states"


@dataclass(frozen=True)
class Held:
    """Documents, chunks and graph of some knowledge bases, as a transaction sees them."""

    documents: DataFrame
    chunks: DataFrame
    graph: Graph

    def with_kb(self) -> dict[str, DataFrame]:
        """All tables by name, each with the knowledge base of its rows."""
        g = self.graph
        of_entity, of_edge, of_community = (t.select("kb_id", k) for t, k in ((g.entities, "entity_id"), (g.relationships, "relationship_id"), (g.communities, "community_id")))
        told = {name: getattr(g, name) for name in TABLES} | {"documents": self.documents, "chunks": self.chunks}
        return told | {"mentions": g.mentions.join(of_entity, "entity_id"), "evidence": g.evidence.join(of_edge, "relationship_id"), "members": g.members.join(of_community, "community_id")}


@dataclass(frozen=True)
class State:
    """A published state: its number, the folders of each table's buckets, the largest number given, and marks by name."""

    number: int
    folders: dict[str, dict[int, str]]
    largest: int
    marks: dict[str, int]

    def told(self) -> str:
        return json.dumps({"folders": self.folders, "largest": self.largest, "marks": self.marks})


class Store:
    """A folder of keyed tables.

    A transaction reads the buckets of its knowledge bases, writes new folders for these buckets alone, and publishes a
    list of all folders under the next number, by a rename that never overwrites. Folders of other buckets stay as they
    are. If another state was published meanwhile, and it changed other buckets and gave no numbers that this one gave
    too, this one is published on top of it; else the transaction runs again.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path, self._context = hadoop.Path, None
        self._hadoop, self._files = hadoop, hadoop.Path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, place: str) -> list[str]:
        path = self._path(f"{self.folder}/{place}")
        return [s.getPath().getName() for s in self._files.listStatus(path)] if self._files.exists(path) else []

    def state(self, number: int | None = None) -> State:
        """A published state, the latest if no number is given; state 0 is empty."""
        numbers = [int(n.removesuffix(".json")) for n in self._names(STATES) if n.endswith(".json") and not n.startswith(".")]
        number = max(numbers, default=0) if number is None else number
        if not number:
            return State(0, {name: {} for name in SCHEMAS}, 0, {})
        told = json.loads(self.spark.read.option("wholetext", True).text(f"{self.folder}/{STATES}/{number:012d}.json").first()[0])
        return State(number, {t: {int(b): f for b, f in own.items()} for t, own in told["folders"].items()}, told["largest"], told["marks"])

    def _bucket(self, kb_id):
        return F.pmod(F.xxhash64(kb_id), F.lit(self.buckets)).cast("int")

    def buckets_of(self, kbs: Iterable[int]) -> list[int]:
        """Buckets of knowledge bases: a short list that the caller states."""
        rows = self.spark.createDataFrame([(k,) for k in kbs], "kb_id long")
        return sorted({r[0] for r in rows.select(self._bucket(F.col("kb_id"))).collect()})

    def _read(self, state: State, table: str, buckets: Iterable[int] | None) -> DataFrame:
        own = state.folders.get(table, {})
        paths = [f"{self.folder}/{own[b]}" for b in sorted(own) if buckets is None or b in buckets]
        return self.spark.read.schema(SCHEMAS[table]).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS[table])

    def load(self, kbs: Iterable[int] | None = None, state: State | None = None) -> Held:
        """The tables of some knowledge bases, or of all; other buckets are not read."""
        state = state or self.state()
        kbs = None if kbs is None else sorted(set(kbs))
        some = None if kbs is None else set(self.buckets_of(kbs))
        tables = {name: self._read(state, name, some) for name in SCHEMAS}
        if kbs is not None:
            tables = {name: t.where(F.col("kb_id").isin(kbs)) for name, t in tables.items()}
        graph = Graph(**{name: tables[name].select(*[c.split(" ")[0] for c in schema.split(", ")]) for name, schema in TABLES.items()}, floor=state.largest)
        return Held(tables["documents"], tables["chunks"], graph)

    def _write(self, state: State, kbs: list[int], some: list[int], held: Held) -> tuple[dict[str, dict[int, str]], int]:
        """New folders of the buckets `some`, in which the rows of `kbs` are those of `held`, and the largest number there."""
        name, folders, largest = uuid.uuid4().hex, {}, state.largest
        for table, rows in held.with_kb().items():
            columns = [c.split(" ")[0] for c in SCHEMAS[table].split(", ")]
            others = self._read(state, table, some).where(~F.col("kb_id").isin(kbs))
            whole = rows.where(F.col("kb_id").isin(kbs)).select(*columns).unionByName(others.select(*columns))
            path = f"{DATA}/{name}/{table}"
            dealt = whole.withColumn("bucket", self._bucket(F.col("kb_id"))).hint("rebalance", "bucket")
            dealt.write.partitionBy("bucket").parquet(f"{self.folder}/{path}")
            made = {int(n.split("=")[1]): f"{path}/{n}" for n in self._names(path) if n.startswith("bucket=")}
            folders[table] = {b: f for b, f in state.folders.get(table, {}).items() if b not in some} | made
            if table in NUMBERED:
                own = self.spark.read.schema(SCHEMAS[table]).parquet(*[f"{self.folder}/{f}" for f in made.values()]) if made else None
                largest = max(largest, (own.agg(F.max(NUMBERED[table])).first()[0] or 0) if own is not None else 0)
        return folders, largest

    def _publish(self, state: State) -> bool:
        """Whether the state got its number; another writer may have been first."""
        held = self._path(f"{self.folder}/{STATES}/.{uuid.uuid4().hex}")
        out = self._files.create(held, False)
        out.write(bytearray(state.told().encode()))
        out.close()
        context = self._hadoop.FileContext.getFileContext(self._files.getUri(), self.spark._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            context.rename(held, self._path(f"{self.folder}/{STATES}/{state.number:012d}.json"), plain)
        except Py4JJavaError:
            self._files.delete(held, False)
            return False
        return True

    def transact(self, kbs: Iterable[int], run: Callable[[Held], Held], mark: tuple[str, int] | None = None, tries: int = 5) -> State:
        """Publish what `run` makes of the stated knowledge bases.

        With a `mark` (name, number) nothing is done if the name has this number or a larger one already, so that a batch
        that is run twice counts once. Fails with StaleGraph if others were first `tries` times.
        """
        kbs = sorted(set(kbs))
        some = self.buckets_of(kbs)
        for _ in range(max(1, tries)):
            base = now = self.state()
            if mark and base.marks.get(mark[0], -1) >= mark[1]:
                return base
            folders, largest = self._write(base, kbs, some, run(self.load(kbs, base)))
            while True:
                changed = {b for t in SCHEMAS for b in {*now.folders.get(t, {}), *base.folders.get(t, {})} if now.folders.get(t, {}).get(b) != base.folders.get(t, {}).get(b)}
                if changed & set(some) or (now.largest != base.largest and largest != base.largest) or (mark and now.marks.get(mark[0], -1) >= mark[1]):
                    break  # run again, on what is there now
                merged = {t: {b: f for b, f in now.folders.get(t, {}).items() if b not in some} | {b: f for b, f in folders[t].items() if b in some} for t in SCHEMAS}
                made = State(now.number + 1, merged, max(now.largest, largest), now.marks | (dict([mark]) if mark else {}))
                if self._publish(made):
                    return made
                now = self.state()
        raise StaleGraph(f"{self.folder} was changed by others {tries} times")

    def clean(self, keep: int = 2) -> int:
        """Delete all but the last `keep` states, and the folders that none of these names; returns how many folders went.

        Nobody may write meanwhile; who reads an older state loses it.
        """
        numbers = sorted(int(n.removesuffix(".json")) for n in self._names(STATES) if n.endswith(".json") and not n.startswith("."))
        kept = [self.state(n) for n in numbers[-keep:]]
        named = {f for s in kept for own in s.folders.values() for f in own.values()}
        gone = 0
        for written in self._names(DATA):
            for table in self._names(f"{DATA}/{written}"):
                for bucket in self._names(f"{DATA}/{written}/{table}"):
                    if bucket.startswith("bucket=") and f"{DATA}/{written}/{table}/{bucket}" not in named:
                        self._files.delete(self._path(f"{self.folder}/{DATA}/{written}/{table}/{bucket}"), True)
                        gone += 1
        for n in numbers[:-keep]:
            self._files.delete(self._path(f"{self.folder}/{STATES}/{n:012d}.json"), False)
        return gone
