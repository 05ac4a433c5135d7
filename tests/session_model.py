"""The session reducer read plainly: every node looked at again at each event. Tests compare the reducer with it."""
import math
from dataclasses import dataclass, field

from quillon.schemas import BUCKET_RANK, OTHER_BUCKET, OTHER_PRIORITY, SECTION_LABELS, TYPE_PRIORITY, WEIGHTS, Policy


@dataclass
class Node:
    node_id: str
    parent: str
    kind: str
    title: str
    summary: str
    tokens: int
    turn: int
    bare: bool  # neither facts nor decisions
    depth: int
    status: str = "active"
    score: float = 0.0
    children: int = 0
    dependencies: tuple[str, ...] = ()


@dataclass
class Session:
    session_id: str
    nodes: list[Node] = field(default_factory=list)
    turn: int = 0
    raw: int = 0
    gc_runs: int = 0
    freed: int = 0

    def __post_init__(self) -> None:
        if not self.nodes:
            self.nodes.append(Node(f"root_{self.session_id}", "", "goal", "Session Root", "", 0, 0, True, 0))

    def active(self) -> list[Node]:
        return [n for n in self.nodes if n.status == "active"]


def tokens(text: str) -> int:
    return len(text.encode()) // 4


def add(s: Session, kind: str, title: str, summary: str, cost: int, bare: bool) -> Node:
    """The event's node under the root (goals, constraints) or the newest active node."""
    s.turn += 1
    parent = s.nodes[0]
    if kind not in ("goal", "constraint"):
        parent = max(s.active(), key=lambda n: n.turn, default=parent)
    node = Node(f"node_{s.session_id}_{s.turn}", parent.node_id, kind, title, summary, cost, s.turn, bare, parent.depth + 1)
    parent.children += 1
    s.nodes.append(node)
    return node


def rescore(s: Session, policy: Policy) -> None:
    active = s.active()
    titles: dict[str, int] = {}
    for n in active:
        titles[n.title.lower()] = titles.get(n.title.lower(), 0) + 1
    for n in active:
        far, twins = s.turn - n.turn, titles[n.title.lower()]
        value = WEIGHTS["recency"] * math.exp(-0.1 * far) + WEIGHTS["type_priority"] * TYPE_PRIORITY.get(n.kind, OTHER_PRIORITY)
        if twins > 1:
            value += WEIGHTS["redundancy"] * min(0.3 * (twins - 1), 1.0)
        if far > policy.stale_after:
            value += WEIGHTS["stale_penalty"] * min((far - policy.stale_after) / policy.stale_after, 1.0)
        if n.tokens > policy.max_node_tokens > 0:
            value += WEIGHTS["size_penalty"] * min(n.tokens / policy.max_node_tokens - 1, 1.0)
        n.score = max(0.0, min(1.0, value))


def reason(s: Session, policy: Policy) -> str | None:
    active = s.active()
    used = sum(n.tokens for n in active)
    if policy.budget > 0 and used > policy.budget:
        return "token_pressure"
    if policy.budget > 0 and 0 < policy.headroom < 1 and used > int(policy.budget * policy.headroom):
        return "soft_headroom"
    if 0 < policy.max_active < len(active):
        return "active_count"
    if max(n.depth for n in s.nodes) > policy.max_depth:
        return "tree_depth"
    if max(n.children for n in s.nodes) > policy.max_children:
        return "tree_width"
    if active and sum(n.score for n in active) / len(active) < policy.threshold:
        return "low_relevance"
    return None


def collect(s: Session, policy: Policy) -> tuple[int, int]:
    """(swept, tokens freed). No parent of an event tree ever has three active compressible children, so nothing compacts."""
    swept = freed = 0
    for n in s.active():
        floor = max(n.score, policy.decision_floor) if n.kind == "decision" and policy.decision_floor > 0 else n.score
        if n.bare and floor < policy.threshold:
            n.status = "archived"
            swept += 1
            freed += n.tokens
    s.gc_runs += 1
    s.freed += freed
    return swept, freed


def compiled(s: Session, budget: int, question: str) -> tuple[int, list[str]]:
    """(compiled tokens, ids chosen) of the active nodes for a question."""
    asked = tokens(question)
    room, used, chosen, texts = budget - asked, 0, [], {}
    rank, before = -1, 0
    for n in sorted(s.active(), key=lambda n: (BUCKET_RANK.get(n.kind, OTHER_BUCKET), -n.score, n.turn, n.node_id)):
        own = BUCKET_RANK.get(n.kind, OTHER_BUCKET)
        if own != rank:
            rank, before = own, used
        cost = n.tokens or tokens(n.summary)
        if before < room and used + cost <= room:
            used += cost
            chosen.append(n.node_id)
            texts.setdefault(own, []).append(f"- {n.summary or n.title}\n")
    prompt = "\n\n---\n\n".join(f"## {SECTION_LABELS[k]}\n" + "".join(texts[k]) for k in sorted(texts))
    return asked + tokens(prompt), chosen


def step(s: Session, event: dict, policy: Policy, compile_each: bool = True) -> dict:
    """Ingests an event (kind, title, summary, payload, token_count, bare) and tells what became of it."""
    s.raw += event["token_count"]
    add(s, event["kind"], event["title"], event["summary"], event["token_count"], event["bare"])
    rescore(s, policy)
    why = reason(s, policy)
    swept, freed = collect(s, policy) if why else (0, 0)
    size = compiled(s, policy.budget, event["payload"])[0] if compile_each else 0
    saved = s.raw - size
    return {
        "turn_number": s.turn,
        "raw_tokens": s.raw,
        "compiled_tokens": size,
        "tokens_saved": saved,
        "reduction_pct": saved / s.raw * 100 if s.raw else 0.0,
        "active_nodes": len(s.active()),
        "total_nodes": len(s.nodes),
        "archived_nodes": sum(n.status == "archived" for n in s.nodes),
        "gc_reason": why,
        "gc_nodes_swept": swept,
        "gc_tokens_freed": freed,
    }


def coherency(s: Session, payloads: list[str], policy: Policy) -> float:
    """Share of passed checks: goals and constraints kept, recent turns in the prompt, dependencies there (where active nodes have any), prompt not empty, budget held."""
    if not payloads:
        return 1.0
    checks = []
    for kind in ("goal", "constraint"):
        own = [n.status == "active" for n in s.nodes if n.kind == kind]
        if own:
            checks.append(sum(own) / len(own) >= 0.5)
    size, chosen = compiled(s, policy.budget, payloads[-1])
    prompt = "\n".join((n.summary or n.title) for n in s.nodes if n.node_id in set(chosen))
    checks += [any(p.encode()[:50] in prompt.encode() for p in payloads[-3:]), bool(chosen), size <= policy.budget]
    there, asked = {n.node_id for n in s.nodes}, {d for n in s.active() for d in n.dependencies}
    if asked:
        checks.append(asked <= there)
    return sum(checks) / len(checks)
