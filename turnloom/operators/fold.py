"""The sequential fold of one session's rounds into its working set, and its distributed run over sessions.

State holds ids, sizes and hashes only; texts stay in the archive. Sessions are independent, so a task steps through those dealt to it
and holds one session's piece descriptors (some 100 bytes each), never its texts.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources import commits, store
from .decisions import OLD_TASK, REASONS, STRUCTURAL_REASONS, UNRELATED

#: Tokens of a batch, of a batch of one, of a piece's wrapper and of a request's.
BATCH_TOKENS, SINGLE_TOKENS = 180_000, 996_000
PIECE_CHARS, REQUEST_CHARS = 160, 400


@dataclass(frozen=True)
class Piece:
    id: str
    source: str
    kind: str
    size: int
    hash: str
    seq: int = 0
    text_hash: str = ""
    duplicates: tuple[str, ...] = ()
    rendered: bool = True
    chars: int = 0

    def absorb(self, other: Piece) -> Piece:
        """This piece, standing for another and for all that stood under it."""
        return replace(self, duplicates=tuple(dict.fromkeys(d for d in (*self.duplicates, other.id, *other.duplicates) if d != self.id)))


class Bare(Piece):
    """A piece of which nobody will ask what went under it: that is counted as it goes, not held."""

    def absorb(self, other: Piece) -> Piece:
        return self


@dataclass(frozen=True)
class Task:
    id: str
    started: int
    last: int
    pieces: tuple[Piece, ...] = ()


@dataclass(frozen=True)
class State:
    round: int = 0
    task: Task | None = None
    archived: tuple[Task, ...] = ()
    pieces: tuple[Piece, ...] = ()
    processed: tuple[str, ...] = ()


@dataclass
class Outcome:
    state: State
    route: str
    candidates: list[str] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)
    guarded: list[str] = field(default_factory=list)
    duplicates: list[str] = field(default_factory=list)


#: A decision policy: evaluated pieces of one batch to {piece id: reason} of those to drop.
Drop = Callable[[list[Piece]], dict[str, str]]
#: A route: None or "new", "same", or a negative index of an archived task.
Route = str | int


def _in_order(pieces: Iterable[Piece]) -> list[Piece]:
    return sorted(pieces, key=lambda p: (p.seq, p.id))


def _collapse(pieces: Iterable[Piece], preferred: set[str]) -> tuple[list[Piece], list[str]]:
    """One piece a hash: the first preferred, else the first; the others' ids."""
    chosen: dict[str, Piece] = {}
    gone = []
    for p in _in_order(pieces):
        c = chosen.get(p.hash)
        if c is None:
            chosen[p.hash] = p
        elif p.id in preferred and c.id not in preferred:
            chosen[p.hash] = p.absorb(c)
            gone.append(c.id)
        else:
            chosen[p.hash] = c.absorb(p)
            gone.append(p.id)
    return _in_order(chosen.values()), gone


def _mark(old: list[Piece], new: list[Piece]) -> tuple[list[Piece], list[Piece], list[str]]:
    """New pieces that repeat an old or earlier new one go under it."""
    by_id = {p.id: p for p in (*old, *new)}
    first: dict[str, str] = {}
    gone = []
    for p in old:
        first.setdefault(p.hash, p.id)
    for p in new:
        keep = first.setdefault(p.hash, p.id)
        if keep != p.id:
            by_id[keep] = by_id[keep].absorb(p)
            gone.append(p.id)
    out = set(gone)
    return [by_id[p.id] for p in old], [by_id[p.id] for p in new if p.id not in out], gone


def _verified(pieces: list[Piece], asked: set[str], new: set[str]) -> tuple[list[Piece], list[str]]:
    """Pieces asked to go as duplicates go if their text is there again."""
    groups: dict[str, list[Piece]] = {}
    for p in _in_order(pieces):
        if p.text_hash:
            groups.setdefault(p.text_hash, []).append(p)
    by_id, gone = {p.id: p for p in pieces}, []
    for group in groups.values():
        free = [p for p in group if p.id not in asked]
        keep = ([p for p in free if p.id in new][-1:] or free[:1] or group[:1])[0]
        for p in group if len(group) > 1 else ():
            if p.id in asked and p.id != keep.id:
                by_id[keep.id] = by_id[keep.id].absorb(p)
                gone.append(p.id)
    out = set(gone)
    return _in_order(p for i, p in by_id.items() if i not in out), gone


def batches(candidates: list[Piece], latest: set[str], limit: int = BATCH_TOKENS, single: int = SINGLE_TOKENS) -> list[list[Piece]]:
    """Next-fit batches within a token limit; a piece too large for any stays unevaluated, one only too large to share goes alone.

    All pieces' manifest, the latest user pieces and as many user pieces as fit (newest first) go with every batch; if not all
    fit, only user pieces are evaluated. Lengths are carried, not recomputed.
    """
    cost = lambda p: p.size + PIECE_CHARS
    shared = REQUEST_CHARS + PIECE_CHARS * len(candidates) + sum(cost(p) for p in candidates if p.id in latest)
    users = [p for p in reversed(_in_order(candidates)) if p.kind == "user" and p.rendered]
    fit = 0
    for p in users:
        if -(-(shared + cost(p)) // 4) <= limit:
            shared += cost(p)
            fit += 1
    out: list[list[Piece]] = []
    current: list[Piece] = []
    chars = shared
    for p in candidates:
        if not p.rendered or fit < len(users) and p.kind != "user":
            continue
        alone = -(-(shared + cost(p)) // 4)
        if alone > single:
            continue
        if alone > limit or -(-(chars + cost(p)) // 4) > limit:
            if current:
                out.append(current)
            current, chars = [], shared
        if alone > limit:
            out.append([p])
            continue
        current.append(p)
        chars += cost(p)
    return [*out, current] if current else out


#: Fixed value: archived tasks on a page that a router is shown.
PAGE = 5


def request_route(state: State, new: list[Piece], answers: Iterable[Route]) -> Route:
    """The route of a round from a router's answers, asked page by page of archived tasks (newest first).

    Without a task it is new, without a user's words the same, and so if the router fails or asks for a page beyond
    the last.
    """
    if state.task is None:
        return "new"
    if not any(p.kind == "user" for p in new):
        return "same"
    offset = 0
    try:
        for a in answers:
            if a != "more":
                return a
            if offset + PAGE >= len(state.archived):
                return "same"
            offset += PAGE
    except Exception:
        return "same"
    return "same"


def step(state: State, new: list[Piece], route: Route, drop: Drop, limit: int = BATCH_TOKENS, single: int = SINGLE_TOKENS) -> Outcome:
    """One round: route, dedupe, evaluate in batches, guard, archive."""
    now = state.round + 1
    new = [replace(p, seq=now) for p in new if p.size > 0]
    if state.task is None:
        route = "new"
    elif isinstance(route, str) and route not in ("new", "same"):
        route = "same"
    revived = None
    if isinstance(route, int):
        if route < 0 and -route <= len(state.archived):
            revived = state.archived[route]
        else:
            route = "same" if state.task else "new"
    archived, base = state.archived, list(state.pieces)
    if route != "same":
        if revived is not None:
            archived = tuple(t for t in archived if t is not revived)
        if state.task and state.pieces:
            archived = (*(t for t in archived if t.id != state.task.id), replace(state.task, pieces=state.pieces, last=now))
    gone: list[str] = []
    if revived is not None:
        task = replace(revived, pieces=(), last=now)
        # A piece that both tasks hold is one piece, not a duplicate of itself.
        base, gone = _collapse({p.id: p for p in (*base, *revived.pieces)}.values(), {p.id for p in revived.pieces})
    else:
        task = state.task if route == "same" else Task(f"task_{now}", now, now)
    if route == "new":
        fresh = new
    else:
        base, fresh, marked = _mark(base, new)
        gone += marked
    candidates = _in_order([*base, *fresh])
    reasons: dict[str, str] = {}
    for batch in batches(candidates, {p.id for p in new if p.kind == "user"}, limit, single):
        ids = {p.id for p in batch}
        try:
            got = drop(batch)
        except Exception:
            got = {}  # keep on failure
        if set(got) <= ids:
            reasons |= got
    old = {p.id for p in base}
    by_id = {p.id: p for p in candidates}
    ok = {i: r for i, r in reasons.items() if r in REASONS and (r != OLD_TASK or route == "new" and i in old and by_id[i].seq < task.started)}
    asked = {i for i, r in ok.items() if r == "exact_duplicate"}
    ok = {i: r for i, r in ok.items() if r != "exact_duplicate"}
    left = [p for p in candidates if p.id not in ok]
    guarded: list[str] = []
    if any(p.kind != "assistant" for p in candidates) and all(p.kind == "assistant" for p in left):
        guarded = [i for i, r in ok.items() if r not in STRUCTURAL_REASONS]
        ok = {i: r for i, r in ok.items() if r in STRUCTURAL_REASONS}
    pieces = [p for p in candidates if p.id not in ok]
    fresh_ids = {p.id for p in fresh}
    if route == "new":
        pieces, more = _collapse(pieces, fresh_ids)
        gone += more
    if asked:
        pieces, more = _verified(pieces, asked, fresh_ids)
        gone += more
    done = State(now, replace(task, pieces=(), last=now) if pieces else None, archived, tuple(pieces), tuple(dict.fromkeys([*state.processed, *(p.source for p in new)])))
    return Outcome(done, str(route), [p.id for p in candidates], list(ok), guarded, gone)


def recall(state: State, offset: int = 0, limit: int = 5) -> tuple[list[str], int]:
    """A page of processed sources that aren't visible, oldest first, and how many are left."""
    seen = {p.source for p in state.pieces}
    gap = [s for s in state.processed if s not in seen]
    return gap[offset : offset + limit], max(0, len(gap) - offset - limit)


def recall_loop(state: State, answers: Iterable[list[tuple[int, int]]], most: int = 3) -> list[tuple[list[str], int]]:
    """What a round recalls: the model's calls (offset, limit) after each answer, until it makes none; more than
    `most` calls in all are an error."""
    pages: list[tuple[list[str], int]] = []
    for calls in answers:
        if not calls:
            return pages
        if len(pages) + len(calls) > most:
            raise ValueError(f"more than {most} recalls in a round")
        pages += [recall(state, o, n) for o, n in calls]
    return pages


def _cap(batch: list[Piece], budget: int = 32_768) -> set[str]:
    kept, used = set(), 0
    for p in reversed(batch):
        if used + p.size <= budget:
            used += p.size
            kept.add(p.id)
    return kept


#: Deterministic policies: which evaluated pieces stay.
POLICIES: dict[str, Callable[[list[Piece]], set[str]]] = {
    "retain-all": lambda b: {p.id for p in b},
    "drop-tools": lambda b: {p.id for p in b if p.kind == "user"},
    "retain-recent": lambda b: {p.id for p in b[-12:]},
    "keep-none": lambda b: set(),
    "cap-bytes": _cap,
}


#: Those that judge each piece by itself: what they kept once they keep again.
BY_PIECE: dict[str, Callable[[Piece], bool]] = {"retain-all": lambda p: True, "drop-tools": lambda p: p.kind == "user"}


def dropping(keep: Callable[[list[Piece]], set[str]]) -> Drop:
    def drop(batch: list[Piece]) -> dict[str, str]:
        kept = keep(batch)
        return {p.id: UNRELATED for p in batch if p.id not in kept}

    return drop


def policy(name: str) -> Drop:
    return dropping(POLICIES[name])


def _answers(told: str | None) -> list[Route]:
    """A router's answers written as words: new, same, more, or revive:-k."""
    return [int(x[7:]) if x.startswith("revive:") else x for x in (told or "same").split(",")]


COLUMNS = "route string, task string, before_pieces long, before_chars long, pieces long, bytes long, added array<string>, removed array<string>, dropped long, guarded long, duplicates long, archived long, processed long, recallable long"

_PIECE = "id:string,source:string,kind:string,size:bigint,hash:string,seq:bigint,text_hash:string,duplicates:array<string>,rendered:boolean,chars:bigint"
_TASK = "id:string,started:bigint,last:bigint"
#: A session's state as a column: what a later run goes on from. `processed` counts sources; which they are is the archive's to know.
STATE = f"struct<round:bigint,task:struct<{_TASK}>,pieces:array<struct<{_PIECE}>>,archived:array<struct<{_TASK},pieces:array<struct<{_PIECE}>>>>,processed:bigint>"


def _packed(state: State, processed: int) -> dict:
    """A state as a value of STATE."""
    own = lambda p: p.__dict__ | {"duplicates": list(p.duplicates)}
    task = lambda t: {"id": t.id, "started": t.started, "last": t.last}
    return {"round": state.round, "task": state.task and task(state.task), "pieces": [own(p) for p in state.pieces], "archived": [task(t) | {"pieces": [own(p) for p in t.pieces]} for t in state.archived], "processed": processed}


def _unpacked(value: dict) -> tuple[State, int]:
    own = lambda ps: tuple(Piece(**{**p, "duplicates": tuple(p["duplicates"])}) for p in ps)
    task = value["task"] and Task(**value["task"])
    return State(value["round"], task, tuple(Task(t["id"], t["started"], t["last"], own(t["pieces"])) for t in value["archived"]), own(value["pieces"])), value["processed"]


class _Session:
    """One session's rounds, one after another.

    The held pieces are kept by id and by hash, with their sums. A round that stays with its task, under a policy that judges each piece by itself, then
    looks at its new pieces only: what is held was kept before and is kept again. All other rounds go through `step`, which costs what is held.
    """

    def __init__(self, key: tuple, drop: Drop, keep: Callable[[Piece], bool] | None):
        self.key, self.drop, self.keep, self.processed = key, drop, keep, 0
        self.seen: set[str] = set()
        self.round: int | None = None
        self.new: list[Piece] = []
        self.told: str | None = None
        self.take(State())

    def take(self, state: State) -> None:
        """Begin to keep what a state holds."""
        self.rest = replace(state, pieces=(), processed=())
        self.held = {p.id: p for p in state.pieces}
        self.by_hash = {p.hash: p.id for p in state.pieces}
        self.chars, self.bytes = sum(p.chars for p in state.pieces), sum(p.size for p in state.pieces)
        self.users = sum(p.size + PIECE_CHARS for p in state.pieces if p.kind == "user")
        self.largest = max((p.size + PIECE_CHARS for p in state.pieces), default=0)
        self.others = sum(p.kind != "assistant" for p in state.pieces)
        self.sources = Counter(p.source for p in state.pieces)
        # A guard may have kept what the policy drops, and a hash may be there twice: then `step` looks at all.
        self.plain = self.keep is not None and len(self.by_hash) == len(state.pieces) and all(map(self.keep, state.pieces))

    def state(self) -> State:
        return replace(self.rest, pieces=tuple(self.held.values()))

    def resume(self, value: dict) -> None:
        state, self.processed = _unpacked(value)
        self.take(state)

    def only_new(self) -> tuple[list[Piece], list[Piece], int] | None:
        """The new pieces that stay, those dropped, and how many go under others; None if all that is held must be looked at."""
        if not self.plain or self.rest.task is None:
            return None
        now = self.rest.round + 1
        new = [replace(p, seq=now) for p in self.new if p.size > 0]
        if len({p.id for p in new}) < len(new) or any(p.id in self.held for p in new):
            return None
        first: dict[str, str] = {}
        fresh, under = {}, []
        for p in new:
            keep = self.by_hash.get(p.hash) or first.setdefault(p.hash, p.id)
            if keep == p.id:
                fresh[p.id] = p
            else:
                under.append((keep, p))
        # In every batch there is room for all user pieces, and no piece is too large to be judged: then all are.
        users = self.users + sum(p.size + PIECE_CHARS for p in new if p.kind == "user")
        shared = REQUEST_CHARS + PIECE_CHARS * (len(self.held) + len(fresh)) + sum(p.size + PIECE_CHARS for p in new if p.kind == "user") + users
        largest = max([self.largest, *(p.size + PIECE_CHARS for p in new)])
        dropped = [p for p in fresh.values() if not self.keep(p)]
        if dropped and (shared > 4 * BATCH_TOKENS or shared + largest > 4 * SINGLE_TOKENS):
            return None
        stay = [p for p in fresh.values() if self.keep(p)]
        if dropped and not self.others and not any(p.kind != "assistant" for p in stay):
            return None  # the guard has its say
        for keep, p in under:
            if keep in fresh:
                fresh[keep] = fresh[keep].absorb(p)
            else:
                self.held[keep] = self.held[keep].absorb(p)
        return sorted((fresh[p.id] for p in stay), key=lambda p: p.id), dropped, len(under)

    def end_round(self) -> tuple:
        n, chars = len(self.held), self.chars
        route = request_route(self.rest, self.new, _answers(self.told))
        found = self.only_new() if route == "same" else None
        if found is not None:
            stay, dropped, under = found
            for p in stay:
                self.held[p.id], self.by_hash[p.hash] = p, p.id
                self.sources[p.source] += 1
                self.chars += p.chars
                self.bytes += p.size
                self.users += (p.size + PIECE_CHARS) * (p.kind == "user")
                self.largest = max(self.largest, p.size + PIECE_CHARS)
                self.others += p.kind != "assistant"
            now = self.rest.round + 1
            self.rest = replace(self.rest, round=now, task=replace(self.rest.task, last=now))
            done, added, removed = ("same", len(dropped), 0, under), [p.id for p in stay], []
        else:
            before = self.state()
            out = step(before, self.new, route, self.drop)
            self.take(out.state)
            done = ("revive" if out.route.startswith("-") else out.route, len(out.dropped), len(out.guarded), len(out.duplicates))
            was = {p.id for p in before.pieces}
            added, removed = [i for i in self.held if i not in was], [p.id for p in before.pieces if p.id not in self.held]
        row = (
            *self.key, self.round, done[0], self.rest.task.id if self.rest.task else None, n, chars, len(self.held), self.bytes, added, removed, done[1], done[2], done[3], len(self.rest.archived),
            self.processed, self.processed - len(self.sources),
        )
        self.round, self.new, self.told = None, [], None
        return row


def replay(pieces: DataFrame, name: str | list[str], session: str = "session", routes: DataFrame | None = None, states: DataFrame | None = None, processed: DataFrame | None = None, with_state: bool = True) -> DataFrame:
    """What each round did under a policy, a row a round: (session, round), COLUMNS and `state`, set in a session's last row.

    pieces: session, round, place, id, source, kind, size, hash, chars, one row a new piece; routes: session, round, told
    (a router's answers, see _answers; same where there are none). before_* is the memory that the round's request held; added and removed
    are the ids that came into it and left it. With a list of policies (names in POLICIES, to which callers add their own) each session is
    folded under each, and `policy` is a column too.

    states (session, state) are those of an earlier run, and processed (session, source) what was processed in it: rounds that follow
    are then folded as if all had been folded at once. Without `with_state`, `state` is null and a task doesn't hold the ids that went under others, which
    grow with all rounds and are held again by each archived task; all other columns are the same. Rows are dealt by session and sorted, and a task steps from session to session over plain
    columns: it holds one session's memory, and its batches of output hold some thousand rounds.
    """
    kind = pieces.schema[session].dataType.simpleString()
    names = [name] if isinstance(name, str) else name
    # Sent as they are, so that a policy that a caller adds to POLICIES works on executors.
    drops, keeps = {n: policy(n) for n in names}, {n: BY_PIECE.get(n) for n in names}
    cols = pieces.select(session, F.col("round").cast("long").alias("round"), "place", "id", "source", "kind", "size", "hash", F.col("chars").cast("long").alias("chars") if "chars" in pieces.columns else F.lit(0).cast("long").alias("chars"))
    cols = cols.withColumn("told", F.lit(None).cast("string")) if routes is None else cols.join(routes.select(session, "round", "told"), [session, "round"], "left")
    cols = cols.withColumn("known", F.lit(False)) if processed is None else cols.join(processed.select(session, "source").distinct().withColumn("known", F.lit(True)), [session, "source"], "left")
    cols = cols.select(session, "round", "place", "id", "source", "kind", "size", "hash", "chars", "told", "known", F.lit(None).cast(STATE).alias("state"))
    if states is not None:
        nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in cols.schema[2:-1]]
        # A state goes before its session's rounds, and only where there are some.
        going = states.select(session, "state").join(pieces.select(session).distinct(), session, "left_semi")
        cols = cols.unionByName(going.select(session, F.lit(-1).cast("long").alias("round"), *nulls, "state"))
    cols = cols.withColumn("policy", F.explode(F.array(*[F.lit(n) for n in names])))
    out_schema = StructType.fromDDL(f"{session} {kind}, policy string, round long, {COLUMNS}, state {STATE}")
    arrow = to_arrow_schema(out_schema)
    piece = Piece if with_state else Bare

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Session | None = None
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

        def end(last: bool) -> None:
            if now is not None and now.round is not None:
                rows.append((*now.end_round(), None))
            if with_state and last and now is not None and rows and rows[-1][:2] == now.key:
                rows[-1] = (*rows[-1][:-1], _packed(now.state(), now.processed))

        for b in batches:
            c = {n: b.column(n).to_pylist() for n in b.schema.names}
            for i, key in enumerate(zip(c[session], c["policy"], strict=True)):
                if now is None or now.key != key:
                    end(True)
                    # A session's last row stays until its state is in it.
                    if len(rows) >= 4096:
                        yield out()
                        rows.clear()
                    now = _Session(key, drops[key[1]], keeps[key[1]])
                if c["state"][i] is not None:
                    now.resume(c["state"][i])
                    continue
                if now.round is not None and now.round != c["round"][i]:
                    end(False)
                    if len(rows) >= 4096:
                        yield out()
                        rows.clear()
                now.round, now.told = c["round"][i], c["told"][i]
                source = c["source"][i]
                if c["size"][i] > 0 and not c["known"][i] and source not in now.seen:
                    now.seen.add(source)
                    now.processed += 1
                now.new.append(piece(c["id"][i], source, c["kind"][i], c["size"][i], c["hash"][i], chars=c["chars"][i]))
        end(True)
        if rows:
            yield out()

    spark = pieces.sparkSession
    dealt = cols.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), session).sortWithinPartitions(session, "policy", "round", "place")
    done = dealt.mapInArrow(run, out_schema)
    return done.drop("policy") if isinstance(name, str) else done


def finalize(pieces: DataFrame, name: str, sources: DataFrame, path: str, session: str = "session", routes: DataFrame | None = None, batch: tuple[str, int] | None = None) -> None:
    """The end of some rounds as one stage: the fold, going on from each session's committed state; then their sources into the
    archive (those it lacks), then the states as versions.

    With a batch (query, batch id) all of it happens once: if the job dies after the archive's commit, what the repeated batch takes as
    processed before is the archive without it; if it dies after the states' commit, nothing is done again.
    """
    spark = pieces.sparkSession
    head = commits.manifest(spark, f"{path}/state")
    if commits.has(head, batch):
        return
    archived = commits.before(spark, f"{path}/archive", batch) if batch else commits.manifest(spark, f"{path}/archive")
    states = store.load_state(spark, f"{path}/state", session, "round") if head else None
    processed = commits.read(spark, f"{path}/archive", head=archived) if archived else None
    work = f"{path}/work/{uuid.uuid4().hex}"
    replay(pieces, name, session, routes, states, processed).write.parquet(work)
    store.archive(spark, sources, f"{path}/archive", [session, "source"], batch)
    store.save_state(spark.read.parquet(work), f"{path}/state", session, "round", batch)


def finalizing(path: str, name: str, query: str, session: str = "session") -> Callable[[DataFrame, int], None]:
    """What foreachBatch calls with the pieces (and their `text`) of rounds that have ended: finalize, once a batch of a query.

    A round comes whole in one batch; a session's rounds come in order. A round that comes again in a later batch is an error.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        try:
            finalize(held.drop("text"), name, held.select(session, "source", "text"), path, session, batch=(query, batch_id))
        finally:
            held.unpersist()

    return sink
