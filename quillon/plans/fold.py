"""The session reducer: one event in, the session's tree, collections and prompt size out.

Plain Python with no Spark import, used by the batch replay and the stream alike. Parents,
triggers and sweeps at a turn depend on all sweeps before it, which no fixed number of window
passes can express. Everything that doesn't (type, title, tokens, facts) is computed as
columns beforehand.

No event looks at all nodes again. A node's score falls with its distance, by a table that all
nodes of the same kind, number of twins and size penalty share; the turn at which it falls under
the threshold is known when it is added and waits in a queue. Tokens, counts, depth, width and
titles are running numbers. From a distance of OLD on, scores no longer change: such nodes lie in
groups of equal score, where the next one that fits a budget is found by the least cost of
blocks. An event's work is bounded by OLD and by what a prompt holds, not by the session."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left, insort
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

from quillon.schemas import BUCKET_RANK, OTHER_BUCKET, OTHER_PRIORITY, SECTION_LABELS, TYPE_PRIORITY, WEIGHTS, Policy

OLD = 400  # from here on recency is lost when it is added to a type's priority in double precision
MOST_TWINS = 5  # more twins take no more from a score
BLOCK = 256


@dataclass(slots=True)
class Node:
    turn: int
    kind: str
    title: str
    text: str  # what a prompt shows
    tokens: int
    cost: int  # tokens, or those of the summary where unset
    bare: bool  # neither facts nor decisions
    parent: int
    depth: int
    active: bool = True
    swept: int | None = None
    children: int = 0
    version: int = 0
    table: "Table | None" = None
    vector: np.ndarray | None = None
    score: float = 0.0  # of the last time it was active, where vectors count
    semantic: float = 0.0
    dependencies: tuple[str, ...] = ()
    rank: int = 0
    size: int = 0

    def __post_init__(self) -> None:
        self.rank = BUCKET_RANK.get(self.kind, OTHER_BUCKET)
        self.size = len(self.text.encode()) + 3


class Table:
    """Scores by distance: `raw` before they are held between 0 and 1, `score` after; cross: the first distance under the threshold."""

    def __init__(self, kind: str, twins: int, tokens: int, policy: Policy):
        fixed = WEIGHTS["type_priority"] * TYPE_PRIORITY.get(kind, OTHER_PRIORITY)
        self.raw = []
        for far in range(max(OLD, 2 * policy.stale_after + 1) + 1):
            value = WEIGHTS["recency"] * math.exp(-0.1 * far) + fixed
            if twins > 1:
                value += WEIGHTS["redundancy"] * min(0.3 * (twins - 1), 1.0)
            if far > policy.stale_after:
                value += WEIGHTS["stale_penalty"] * min((far - policy.stale_after) / policy.stale_after, 1.0)
            if tokens > policy.max_node_tokens > 0:
                value += WEIGHTS["size_penalty"] * min(tokens / policy.max_node_tokens - 1, 1.0)
            self.raw.append(value)
        self.score = [max(0.0, min(1.0, v)) for v in self.raw]
        floor = policy.decision_floor if kind == "decision" and policy.decision_floor > 0 else 0.0
        self.cross = next((far for far, v in enumerate(self.score) if max(v, floor) < policy.threshold), None)


#: scores depend on nothing of a session, so that all sessions of a worker share them
table_of = lru_cache(maxsize=1024)(Table)


class Group:
    """Nodes of one bucket and score, in order of turn, in blocks that know their least cost."""

    def __init__(self):
        self.blocks: list[list[tuple[int, int]]] = []  # (turn, cost)
        self.least: list[int] = []
        self.first: list[int] = []
        self.count = 0

    def add(self, turn: int, cost: int) -> None:
        k = max(0, bisect_left(self.first, turn + 1) - 1)
        if not self.blocks:
            self.blocks, self.least, self.first = [[]], [cost], [turn]
        insort(self.blocks[k], (turn, cost))
        self.least[k], self.first[k] = min(self.least[k], cost), self.blocks[k][0][0]
        self.count += 1
        if len(self.blocks[k]) > BLOCK:
            self._set(k, self.blocks[k][: BLOCK // 2], self.blocks[k][BLOCK // 2 :])

    def remove(self, turn: int) -> None:
        k = bisect_left(self.first, turn + 1) - 1
        self._set(k, [x for x in self.blocks[k] if x[0] != turn])
        self.count -= 1

    def _set(self, k: int, *blocks: list[tuple[int, int]]) -> None:
        blocks = [b for b in blocks if b]
        self.blocks[k : k + 1] = blocks
        self.least[k : k + 1] = [min(c for _, c in b) for b in blocks]
        self.first[k : k + 1] = [b[0][0] for b in blocks]

    def fitting(self, room: int):
        """(turn, cost) in order of turn, each with a cost of at most what the ones before leave of room."""
        for k in range(len(self.blocks)):
            if self.least[k] <= room:
                for turn, cost in self.blocks[k]:
                    if cost <= room:
                        room -= cost
                        yield turn, cost


@dataclass
class Session:
    """A session's tree. With `semantic`, nodes have vectors and are scored against the last user's one."""

    session_id: str
    policy: Policy = Policy()
    semantic: bool = False
    turn: int = 0
    raw: int = 0
    gc_runs: int = 0
    freed: int = 0
    archived: int = 0
    tokens: int = 0
    deepest: int = 0
    widest: int = 0
    anchor_turn: int = 0  # of the last user's node that has a vector
    anchor: np.ndarray | None = None
    nodes: dict[int, Node] = field(default_factory=dict)
    touched: set[int] = field(default_factory=set)  # turns of nodes that an event has added or changed

    def __post_init__(self) -> None:
        self._tables: dict[tuple, Table] = {}
        self._recent: dict[int, Node] = {}  # active and nearer than OLD, by turn
        self._groups: dict[tuple[int, float], Group] = {}
        self._queue: list[tuple[int, int, int]] = []
        self._titles: dict[str, set[int]] = {}
        self._newest: list[int] = []
        self._left: list[Node] = []
        self._active = 0
        if not self.nodes:
            self._enter(Node(0, "goal", "Session Root", "Session Root", 0, 0, True, -1, 0))

    @property
    def root(self) -> Node:
        return self.nodes[0]

    def node_id(self, turn: int) -> str:
        return f"node_{self.session_id}_{turn}" if turn else f"root_{self.session_id}"

    def active(self) -> list[Node]:
        return [n for n in self.nodes.values() if n.active]

    @property
    def n_active(self) -> int:
        return self._active

    @classmethod
    def restored(cls, session_id: str, nodes: list[Node], policy: Policy = Policy(), semantic: bool = False, **numbers) -> "Session":
        """A session of stored nodes, of which archived ones may be left out, and its running numbers."""
        s = cls(session_id, policy, semantic, nodes={-1: None}, **numbers)
        s.nodes = {}
        for n in sorted(nodes, key=lambda n: n.turn):
            s._enter(n)
        if semantic and s.anchor_turn in s.nodes:
            s.anchor = s.nodes[s.anchor_turn].vector
        s._age()
        s.touched = set()
        return s

    # --- nodes -----------------------------------------------------------------------

    def _enter(self, n: Node) -> None:
        self.nodes[n.turn] = n
        self.touched.add(n.turn)
        if n.active:
            self._active += 1
            self._newest.append(n.turn)
            twins = self._titles.setdefault(n.title.lower(), set())
            twins.add(n.turn)
            self._recent[n.turn] = n
            self._retitle(twins, n.turn)

    def _retitle(self, twins: set[int], new: int | None = None) -> None:
        """Scores after a change in the number of twins; beyond MOST_TWINS only a new node's."""
        k = min(len(twins), MOST_TWINS)
        for turn in [new] if new is not None and len(twins) > MOST_TWINS else twins:
            n = self.nodes[turn]
            excess = n.tokens if n.tokens > self.policy.max_node_tokens > 0 else 0
            key = (n.kind, k, excess)
            table = self._tables.get(key)
            if table is None:
                table = self._tables[key] = table_of(n.kind, k, excess, self.policy)
            if table is n.table:
                continue
            if turn not in self._recent and n.table is not None:
                self._group(n).remove(turn)
                n.table = table
                self._group(n).add(turn, n.cost)
            n.table, n.version = table, n.version + 1
            if n.bare and table.cross is not None and not self.semantic:
                heapq.heappush(self._queue, (turn + table.cross, turn, n.version))

    def _group(self, n: Node) -> Group:
        return self._groups.setdefault((n.rank, n.table.score[-1]), Group())

    def _age(self) -> None:
        """Nodes whose score no longer changes go to the groups."""
        while self._recent and not self.semantic:
            turn = next(iter(self._recent))
            n = self._recent[turn]
            if self.turn - turn < len(n.table.raw) - 1:
                break
            del self._recent[turn]
            self._group(n).add(turn, n.cost)

    def _leave(self, n: Node) -> None:
        n.active, n.swept = False, self.turn
        self.touched.add(n.turn)
        self._active -= 1
        self.archived += 1
        self.tokens -= n.tokens
        if n.turn in self._recent:
            del self._recent[n.turn]
        else:
            self._group(n).remove(n.turn)
        self._left.append(n)

    def _settle(self) -> None:
        """Twins of what the last collection swept. Until the next event, scores stay what they were before it."""
        for n in self._left:
            self._titles[n.title.lower()].discard(n.turn)
        for title in {n.title.lower() for n in self._left}:
            twins = self._titles[title]
            if len(twins) < MOST_TWINS:
                self._retitle(twins)
            if not twins:
                del self._titles[title]
        self._left = []

    def newest(self) -> Node:
        """The newest active node, or the root."""
        while self._newest and not self.nodes[self._newest[-1]].active:
            self._newest.pop()
        return self.nodes[self._newest[-1]] if self._newest else self.nodes[0]

    # --- scores ----------------------------------------------------------------------

    def score_of(self, n: Node) -> float:
        if self.semantic or not n.active:
            return n.score
        return n.table.score[min(self.turn - n.turn, len(n.table.score) - 1)]

    def rescore(self) -> None:
        """Scores against the anchor; without vectors they are looked up when they are needed."""
        if not self.semantic:
            return
        nodes = list(self._recent.values())
        raw = np.array([n.table.raw[min(self.turn - n.turn, len(n.table.raw) - 1)] for n in nodes])
        near = np.zeros(len(nodes))
        if self.anchor is not None:
            held = [k for k, n in enumerate(nodes) if n.vector is not None and len(n.vector) == len(self.anchor)]
            if held:
                near[held] = cosines(np.array([nodes[k].vector for k in held]), self.anchor)
        for n, score, x in zip(nodes, np.clip(raw + WEIGHTS["semantic"] * near, 0.0, 1.0).tolist(), near.tolist()):
            n.score, n.semantic = score, x

    def mean(self) -> float:
        if self.semantic:
            return math.fsum(n.score for n in self._recent.values()) / max(1, self._active)
        now = self.turn
        total = [n.table.score[now - n.turn] for n in self._recent.values()]
        total += [g.count * score for (_, score), g in self._groups.items()]
        return math.fsum(total) / max(1, self._active)

    # --- collection --------------------------------------------------------------------

    def reason(self) -> str | None:
        p = self.policy
        if p.budget > 0 and self.tokens > p.budget:
            return "token_pressure"
        if p.budget > 0 and 0 < p.headroom < 1 and self.tokens > int(p.budget * p.headroom):
            return "soft_headroom"
        if 0 < p.max_active < self._active:
            return "active_count"
        if self.deepest > p.max_depth:
            return "tree_depth"
        if self.widest > p.max_children:
            return "tree_width"
        if self._active and self.mean() < p.threshold:
            return "low_relevance"
        return None

    def _under(self) -> list[Node]:
        """Bare active nodes under the threshold."""
        if self.semantic:
            floor = lambda n: self.policy.decision_floor if n.kind == "decision" and self.policy.decision_floor > 0 else 0.0
            return [n for n in self._recent.values() if n.bare and max(n.score, floor(n)) < self.policy.threshold]
        out = []
        while self._queue and self._queue[0][0] <= self.turn:
            _, turn, version = heapq.heappop(self._queue)
            n = self.nodes.get(turn)
            if n and n.active and n.version == version:
                out.append(n)
        return out

    def collect(self) -> tuple[int, int]:
        """(swept, tokens freed). No parent of an event tree ever has three active compressible children, so nothing compacts."""
        under = self._under()
        freed = sum(n.tokens for n in under)
        for n in under:
            if not self.semantic:
                n.score = self.score_of(n)
        for n in under:
            self._leave(n)
        self.gc_runs += 1
        self.freed += freed
        return len(under), freed

    # --- prompt ------------------------------------------------------------------------

    def compiled(self, budget: int, question: str, system: str = "", hits: list[tuple[int, float]] = ()) -> tuple[int, list[int]]:
        """(compiled tokens, turns of the nodes chosen) for a question that is sent beside the prompt.

        hits: (turn, score) of nodes that a search found; they take the score of the search in
        place of their semantic share, and archived ones among them are considered too."""
        asked = tokens(question) + tokens(system)
        room, used, chosen = budget - asked, 0, []
        if self.semantic:
            found = {turn: hit for turn, hit in hits if turn in self.nodes}
            effective = lambda n: n.score + WEIGHTS["semantic"] * (found[n.turn] - n.semantic) if n.turn in found else n.score
            more = [n for n in (self.nodes[t] for t in found) if not n.active]
            items: list[tuple] = [(n.rank, -effective(n), n.turn, n.cost, None) for n in [*self._recent.values(), *more]]
        else:
            now = self.turn
            items = [(n.rank, -n.table.score[now - n.turn], n.turn, n.cost, None) for n in self._recent.values()]
            items += [(rank, -score, -1, 0, group) for (rank, score), group in self._groups.items() if group.count]
        items.sort(key=lambda x: x[:3])
        size, rank, open_, new = 0, -1, False, True
        for own, _, turn, cost, group in items:
            if own != rank:
                rank, open_, new = own, used < room, True
            if not open_:
                continue
            for at, c in group.fitting(room - used) if group else [(turn, cost)] if used + cost <= room else []:
                used += c
                size += self.nodes[at].size + (new and len(SECTION_LABELS[own]) + 4 + (7 if chosen else 0))
                new = False
                chosen.append(at)
        return asked + size // 4, chosen

    def prompt(self, chosen: list[int], stable: bool = False) -> str:
        """The text of the nodes that `compiled` chose, in its order or, if stable, by turn within each section."""
        sections: dict[int, list[int]] = {}
        for turn in chosen:
            sections.setdefault(self.nodes[turn].rank, []).append(turn)
        lines = lambda turns: "".join(f"- {self.nodes[t].text}\n" for t in (sorted(turns) if stable else turns))
        return "\n\n---\n\n".join(f"## {SECTION_LABELS[rank]}\n{lines(sections[rank])}" for rank in sorted(sections))


def cosines(rows: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of each row with x, 0 where a norm is 0."""
    norms = np.sqrt((rows * rows).sum(axis=1)) * math.sqrt(float(x @ x))
    return np.divide(rows @ x, norms, out=np.zeros(len(rows)), where=norms > 0)


def tokens(text: str) -> int:
    return len(text.encode()) // 4


def add(s: Session, kind: str, title: str, summary: str, cost: int, bare: bool, vector=None) -> Node:
    """The event's node under the root (goals, constraints) or the newest active node."""
    s.turn += 1
    s._settle()
    s._age()
    parent = s.root if kind in ("goal", "constraint") else s.newest()
    node = Node(s.turn, kind, title, summary or title, cost, cost or tokens(summary), bare, parent.turn, parent.depth + 1)
    if vector is not None:
        node.vector = np.asarray(vector, np.float64)
    parent.children += 1
    s.touched.add(parent.turn)
    s.deepest, s.widest, s.tokens = max(s.deepest, node.depth), max(s.widest, parent.children), s.tokens + cost
    s._enter(node)
    return node


def nearest(s: Session, vector: np.ndarray, k: int, places: int) -> list[tuple[int, float]]:
    """(turn, hit) of the k nearest active and the k nearest archived nodes: cosines to some places, held between 0 and 1."""
    out = []
    for active in (True, False):
        held = [n for n in s.nodes.values() if n.active == active and n.vector is not None and len(n.vector) == len(vector)]
        if held:
            hits = np.clip(np.round(cosines(np.array([n.vector for n in held]), vector), places), 0.0, 1.0).tolist()
            out += [(n.turn, hit) for hit, n in sorted(zip(hits, held), key=lambda x: (-x[0], x[1].turn))[:k]]
    return out


def ingest(s: Session, event: dict) -> tuple[str | None, int, int]:
    """Adds an event (kind, title, summary, token_count, bare; with vectors also vector, is_user) and collects: (reason, swept, freed)."""
    s.raw += event["token_count"]
    node = add(s, event["kind"], event["title"], event["summary"], event["token_count"], event["bare"], event.get("vector") if s.semantic else None)
    if s.semantic and event.get("is_user") and node.vector is not None:
        s.anchor, s.anchor_turn = node.vector, node.turn
    s.rescore()
    why = s.reason()
    swept, freed = s.collect() if why else (0, 0)
    return why, swept, freed


def step(s: Session, event: dict, compile_each: bool = True) -> dict:
    """Ingests an event (also its payload, and hits of a search at it or, as `search`, how many and to how many places are looked for here) and tells what became of it."""
    why, swept, freed = ingest(s, event)
    if s.semantic and event.get("search") and event.get("is_user") and event["payload"] and s.nodes[s.turn].vector is not None:
        event = event | {"hits": nearest(s, s.nodes[s.turn].vector, *event["search"])}
    size = s.compiled(s.policy.budget, event["payload"], hits=event.get("hits") or ())[0] if compile_each else 0
    saved = s.raw - size
    return {
        "turn_number": s.turn,
        "raw_tokens": s.raw,
        "compiled_tokens": size,
        "tokens_saved": saved,
        "reduction_pct": saved / s.raw * 100 if s.raw else 0.0,
        "active_nodes": s.n_active,
        "total_nodes": s.n_active + s.archived,
        "archived_nodes": s.archived,
        "gc_reason": why,
        "gc_nodes_swept": swept,
        "gc_tokens_freed": freed,
    }


def coherency(s: Session, payloads: list[str]) -> float:
    """Share of passed checks: goals and constraints kept, recent turns in the prompt (by their first 50 bytes), dependencies there (where active nodes have any), prompt not empty, budget held."""
    if not payloads:
        return 1.0
    checks = []
    for kind in ("goal", "constraint"):
        own = [n.active for n in s.nodes.values() if n.kind == kind]
        if own:
            checks.append(sum(own) / len(own) >= 0.5)
    size, chosen = s.compiled(s.policy.budget, payloads[-1])
    prompt = "\n".join(s.nodes[t].text for t in sorted(chosen)).encode()
    checks += [any(p.encode()[:50] in prompt for p in payloads[-3:]), bool(chosen), size <= s.policy.budget]
    there, asked = {s.node_id(t) for t in s.nodes}, {d for n in s.active() for d in n.dependencies}
    if asked:
        checks.append(asked <= there)
    return sum(checks) / len(checks)
