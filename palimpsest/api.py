"""Add, search, list, count and delete memories of a store, as one object."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import context as C
from palimpsest.operators import search as S
from palimpsest.operators import tables as T
from palimpsest.plans.filters import Comparison, compile_filter, parse_filter, resolver
from palimpsest.sources.store import KeptCounts, TableStore

EPISODES = "uid string, session_key string, producer_id string, producer_role string, content string, created_at timestamp, metadata string, embedding array<float>"
FIELDS = {"uid": "uid", "id": "uid", "session": "session_key", "session_key": "session_key", "producer_id": "producer_id", "producer_role": "producer_role", "created_at": "created_at"}


def hashed_embedding(text: Column, dimensions: int = 64) -> Column:
    """A deterministic default embedder: words are counted, with signs, by hash. It stands in for a model."""
    words = F.filter(F.split(F.lower(text), r"\W+"), lambda w: w != "")
    # each word is hashed once; the places of the plus and of the minus words are then counted
    places = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(2 * dimensions)).cast("int"))
    count = lambda found, k: F.size(F.filter(found, lambda p: p == k))
    return F.transform(F.array(places), lambda found: F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda k: (count(found, 2 * k) - count(found, 2 * k + 1)).cast("float")))[0]


class Memory:
    def __init__(self, store: TableStore, embed: Callable[[Column], Column] = hashed_embedding, table: str = "episodes"):
        self.store, self.embed, self.table = store, embed, table
        self.counts = KeptCounts(store, table, "session_key")

    def _rows(self) -> DataFrame:
        return self.store.read(self.table, EPISODES)

    def _where(self, text: str | None) -> Column:
        return F.coalesce(compile_filter(parse_filter(text), resolver(FIELDS, "metadata", ignore_case=True)), F.lit(False))

    def add(self, messages: DataFrame) -> None:
        """Adds messages (session_key, content, created_at, and optionally the other columns). Ids come from what a message says and when, so adding again changes nothing."""
        have = set(messages.columns)
        pick = lambda name, default: F.coalesce(F.col(name), default) if name in have else default
        rows = messages.select("session_key", pick("producer_id", F.lit("user")).alias("producer_id"), pick("producer_role", F.lit("user")).alias("producer_role"), "content", "created_at", pick("metadata", F.lit("{}")).alias("metadata"))
        uid = F.sha2(F.concat_ws("|", "session_key", "producer_id", F.unix_micros("created_at").cast("string"), "content"), 256)
        new = rows.select(uid.alias("uid"), *rows.columns, self.embed(F.col("content")).alias("embedding")).dropDuplicates(["uid"])
        self.store.append(self.table, new.join(self._rows().select("uid"), "uid", "left_anti").select(*[f.name for f in self._rows().schema]), EPISODES)

    def search(self, query: str, limit: int = 10, where: str | None = None, expand: int = 0, threshold: float | None = None, columns: Sequence[str] | None = None) -> DataFrame:
        """The best episodes for a text, ranked, each with its neighbours in its session if expand > 0; of an episode only the given columns if there are any."""
        rows = self._rows().where(self._where(where))
        wanted = self._named(columns)
        queries = self.store.spark.range(1).select(F.lit(0).alias("query_id"), self.embed(F.lit(query)).alias("query_vector"))
        hits = S.knn(queries, rows, limit, "cosine", threshold).select(F.col("uid").alias("seed"), "score", "rank")
        backward, forward = C.split_expansion(expand)
        needed = [c for c in rows.columns if c in {*wanted, "uid", "session_key", "created_at"}]
        found = C.neighbours(rows.select(*needed), hits, ["session_key"], ["created_at", "uid"], "uid", backward, forward)
        return hits.join(found, "seed").orderBy("rank", "distance").select("seed", "score", "rank", "distance", *wanted)

    def list(self, where: str | None = None, page_size: int | None = None, page: int | None = None, columns: Sequence[str] | None = None) -> DataFrame:
        """Episodes in the order of time, or a page of them; only the given columns if there are any."""
        return T.page(self._rows().where(self._where(where)).drop("embedding"), [F.col("created_at"), F.col("uid")], page_size, page).select(*self._named(columns))

    def _named(self, columns: Sequence[str] | None) -> Sequence[str]:
        """Columns of an episode, all but the vector if none are given; a name that is none raises."""
        every = [f.name for f in self._rows().schema]
        if unknown := [c for c in columns or [] if c not in every]:
            raise KeyError(unknown[0])
        return [*columns] if columns else [c for c in every if c != "embedding"]

    def count(self, where: str | None = None) -> int:
        """Episodes that pass; of one session alone from the counts that are kept (KeptCounts)."""
        tree = parse_filter(where) if where else None
        if isinstance(tree, Comparison) and tree.op == "=" and FIELDS.get(tree.field) == "session_key" and self.store.exists(self.table):
            return self.counts.of(tree.value)
        return self._rows().where(self._where(where)).count()

    def delete(self, where: str) -> None:
        """Deletes the episodes that pass: their ids are written, not the table."""
        if self.store.exists(self.table):
            self.store.delete(self.table, self._rows().where(self._where(where)).select("uid"), "uid")
