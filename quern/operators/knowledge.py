"""Knowledge maps: priors, evidence, propagation, probes, coverage, fringes, lint."""

from __future__ import annotations

from math import log2

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Belief that an answer gives, and the probe range.
FAMILIARITY = {"none": 0.05, "heard_of": 0.40, "basic": 0.70, "solid": 0.85, "deep": 0.95}
PROBE_LOW, PROBE_HIGH = 0.05, 0.85
OVERCLAIM, UNDERCLAIM = 0.15, 0.05
NOISY_AND, LEAK = 0.90, 0.05


def prior(obscurity: Column) -> Column:
    return F.greatest(F.lit(0.05), 0.5 - 0.08 * F.coalesce(obscurity, F.lit(3)))


def belief_of(familiarity: Column) -> Column:
    """Belief after a direct answer; an unknown label gives null."""
    return F.create_map(*[F.lit(x) for kv in FAMILIARITY.items() for x in kv])[familiarity]


def noisy_update(p: Column, claims_known: Column, over: float = OVERCLAIM, under: float = UNDERCLAIM) -> Column:
    """Posterior of knowing after a claim that may be over- or understated."""
    yes = p * (1 - under) / (p * (1 - under) + (1 - p) * over)
    no = p * under / (p * under + (1 - p) * (1 - over))
    return F.when(claims_known, yes).otherwise(no)


def entropy(p: Column) -> Column:
    q = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), p))
    return F.when((p <= 0) | (p >= 1), F.lit(0.0)).otherwise(-q * F.log2(q) - (1 - q) * F.log2(1 - q))


def coverage(beliefs: DataFrame, by: str | None = None) -> DataFrame:
    """Nodes known (>= .7), unknown (<= .2) and uncertain, entropy and share assessed, of all or by a column."""
    known, unknown = F.count_if(F.col("belief") >= 0.7), F.count_if(F.col("belief") <= 0.2)
    g = beliefs.groupBy(by) if by else beliefs.groupBy()
    return g.agg(
        F.count("*").alias("nodes"), known.alias("known"), unknown.alias("unknown"), (F.count("*") - known - unknown).alias("uncertain"),
        F.round(F.sum(entropy(F.col("belief"))), 6).alias("entropy"), F.round(100.0 * F.count_if("assessed") / F.count("*"), 1).alias("pct"),
    )


def converged(beliefs: DataFrame, by: str, most: int = 3) -> DataFrame:
    return beliefs.groupBy(by).agg((F.count_if((F.col("belief") > 0.2) & (F.col("belief") < 0.8)) <= most).alias("converged"))


def foil_factor(responses: DataFrame, by: str) -> DataFrame:
    """``by, factor``: 1 - share of foils claimed basic, solid or deep; no foils give 1."""
    return responses.groupBy(by).agg(F.round(1 - F.coalesce(F.avg(F.when(F.col("familiarity").isin("basic", "solid", "deep"), 1.0).otherwise(0.0)), F.lit(0.0)), 6).alias("factor"))


def calibrate(belief: Column, factor: Column) -> Column:
    f = F.greatest(F.lit(0.0), F.least(F.lit(1.0), factor))
    return F.when(belief > 0.5, 0.5 + (belief - 0.5) * f).otherwise(belief)


def fringes(beliefs: DataFrame, edges: DataFrame, known: float = 0.7) -> DataFrame:
    """``g, n, fringe``: inner: known with a child not known; outer: not known, all parents known (roots too)."""
    b = beliefs.select("g", "n", (F.col("belief") >= known).alias("k"))
    parent, child = b.select("g", F.col("n").alias("p"), F.col("k").alias("pk")), b.select("g", F.col("n").alias("c"), F.col("k").alias("ck"))
    e = edges.join(parent, ["g", "p"]).join(child, ["g", "c"])
    inner = e.where("pk AND NOT ck").select("g", F.col("p").alias("n"), F.lit("inner").alias("fringe")).distinct()
    outer = b.where("NOT k").select("g", "n").join(e.where("NOT pk").select("g", F.col("c").alias("n")), ["g", "n"], "left_anti").withColumn("fringe", F.lit("outer"))
    return inner.unionByName(outer)


def lint(nodes: DataFrame) -> DataFrame:
    """``g, n, issue``: long titles, obscure roots, thin descriptions."""
    few = F.coalesce(F.size("prerequisites"), F.lit(0)) <= 0
    issue = F.array_compact(F.array(
        F.when(F.size(F.split(F.coalesce("description", F.lit("")), r"[.!?]+\s+")) >= 3, "several sentences"),
        F.when(few & (F.coalesce("obscurity", F.lit(3)) >= 4), "obscure without prerequisites"),
        F.when(F.length(F.coalesce("description", F.lit(""))) < 10, "thin description"),
    ))
    return nodes.select("g", "n", F.explode(issue).alias("issue"))


class Map:
    """One learner's graph with beliefs; small, and the sequential algorithms run on it inside a task."""

    def __init__(self, nodes: list, edges: list, belief: dict, assessed: set):
        self.order, self.belief, self.assessed = list(nodes), dict(belief), set(assessed)
        self.up: dict = {n: [] for n in nodes}
        self.down: dict = {n: [] for n in nodes}
        for p, c in edges:
            if p in self.up and c in self.up:
                self.up[c].append(p)
                self.down[p].append(c)

    def _reach(self, start, step: dict) -> dict:
        depth, queue = {}, [(start, 0)]
        while queue:
            n, d = queue.pop()
            for m in step[n]:
                if m not in depth and m != start:
                    depth[m] = d + 1
                    queue.append((m, d + 1))
        return depth

    def observe(self, n, familiarity: str, heuristic: bool) -> None:
        self.belief[n] = FAMILIARITY[familiarity]
        self.assessed.add(n)
        if not heuristic:
            self.bayes()
            return
        if familiarity in ("none", "heard_of"):
            for m, d in self._reach(n, self.down).items():
                if m not in self.assessed:
                    self.belief[m] = min(self.belief[m], 0.1 * 0.8**d)
        else:
            floor = 0.65 if familiarity == "basic" else 0.8
            for m, d in self._reach(n, self.up).items():
                if m not in self.assessed:
                    self.belief[m] = max(self.belief[m], 1 - (1 - floor) * 0.8**d)
        self.sweep()

    def sweep(self) -> None:
        """At most three passes that pull unassessed nodes towards their prerequisites."""
        for _ in range(3):
            moved = False
            for n in self.order:
                if n in self.assessed or not self.up[n]:
                    continue
                m = min(self.belief[p] for p in self.up[n])
                new = self.belief[n]
                if m >= 0.5:
                    new = max(new, 0.5 + 0.35 * (m - 0.5) / 0.5)
                elif m < 0.2:
                    new = min(new, 0.15 + 0.35 * m / 0.2)
                moved |= new != self.belief[n]
                self.belief[n] = new
            if not moved:
                return

    def topological(self) -> list:
        seen, out = set(), []
        for start in self.order:
            stack = [(start, False)]
            while stack:
                n, done = stack.pop()
                if done:
                    out.append(n)
                elif n not in seen:
                    seen.add(n)
                    stack.append((n, True))
                    stack += [(p, False) for p in reversed(self.up[n]) if p not in seen]
        return out

    def bayes(self) -> None:
        """One forward and one backward pass of noisy-AND belief propagation from the assessed nodes."""
        if not self.assessed:
            return
        order = self.topological()
        seen = {n: self.belief[n] >= 0.5 for n in self.assessed}
        pi: dict = {}
        for n in order:
            if n in seen:
                pi[n] = 1.0 if seen[n] else 0.0
            elif not self.up[n]:
                pi[n] = self.belief[n]
            else:
                every = 1.0
                for p in self.up[n]:
                    every *= pi.get(p, self.belief[p])  # a cycle has no order: its prior stands in
                pi[n] = NOISY_AND * every + LEAK * (1 - every)
        lam = {n: [1.0, 1.0] for n in order}
        for n in reversed(order):
            mine = ([0.0, 1.0] if seen[n] else [1.0, 0.0]) if n in seen else lam[n]
            for p in self.up[n]:
                others = 1.0
                for q in self.up[n]:
                    if q != p:
                        others *= pi.get(q, self.belief[q])
                for k in (0, 1):
                    know = (NOISY_AND * others + LEAK * (1 - others)) if k else LEAK
                    lam[p][k] *= mine[1] * know + mine[0] * (1 - know)
                total = sum(lam[p]) or 1.0
                lam[p] = [x / total for x in lam[p]]
        for n in order:
            if n not in seen:
                a, b = pi[n] * lam[n][1], (1 - pi[n]) * lam[n][0]
                self.belief[n] = min(0.99, max(0.01, a / (a + b) if a + b else 0.5))

    def copy(self) -> Map:
        other = Map.__new__(Map)
        other.order, other.up, other.down = self.order, self.up, self.down
        other.belief, other.assessed = dict(self.belief), set(self.assessed)
        return other

    def total_entropy(self) -> float:
        return sum(-p * log2(p) - (1 - p) * log2(1 - p) for p in self.belief.values() if 0 < p < 1)

    def candidates(self) -> list:
        return [n for n in self.order if n not in self.assessed and PROBE_LOW <= self.belief[n] <= PROBE_HIGH]

    def next_probe(self):
        """Node with the greatest expected fall of entropy; answers are simulated with the heuristic rules."""
        best, gain = None, None
        now = self.total_entropy()
        for n in self.candidates():
            weights = {a: max(0.0, 1 - abs(self.belief[n] - b)) for a, b in FAMILIARITY.items()}
            total = sum(weights.values())
            left = 0.0
            for a, w in weights.items():
                trial = self.copy()
                trial.observe(n, a, True)
                left += w / total * trial.total_entropy()
            if gain is None or now - left > gain:
                best, gain = n, now - left
        return best, gain

    def probes(self, count: int) -> list:
        """The next probes one after the other, each answered as its belief suggests."""
        state, out = self.copy(), []
        for _ in range(count):
            n, _ = state.next_probe()
            if n is None:
                break
            out.append(n)
            state.observe(n, "solid" if state.belief[n] > 0.5 else "none", True)
        return out


def learners(nodes: DataFrame, edges: DataFrame, responses: DataFrame, mode: str = "bayesian", probe_count: int = 0) -> DataFrame:
    """Beliefs of each learner after ``responses`` (``learner, g, n, familiarity, seq``), or the next probes.

    A learner's graph is what one task works on (it must fit there); learners run in parallel.
    ``learner, g, n, belief, assessed`` or, with ``probe_count``, ``learner, g, n, place``.
    """
    graph = nodes.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("n", prior(F.col("obscurity")).alias("p")))).alias("nodes"))
    links = edges.groupBy("g").agg(F.array_sort(F.collect_set(F.struct("p", "c"))).alias("links"))
    answers = responses.groupBy("learner", "g").agg(F.array_sort(F.collect_list(F.struct("seq", "n", "familiarity"))).alias("answers"))
    each = answers.join(graph, "g").join(links, "g", "left")

    def run(batches):
        for b in batches:
            rows = []
            for learner, g, ns, ls, given in zip(b["learner"], b["g"], b["nodes"], b["links"], b["answers"]):
                m = Map([x["n"] for x in ns], [(x["p"], x["c"]) for x in (ls if ls is not None else [])], {x["n"]: x["p"] for x in ns}, set())
                for a in given:
                    if a["n"] in m.belief and a["familiarity"] in FAMILIARITY:
                        m.observe(a["n"], a["familiarity"], mode == "heuristic")
                if probe_count:
                    rows += [(learner, g, n, float(i), False) for i, n in enumerate(m.probes(probe_count))]
                else:
                    rows += [(learner, g, n, m.belief[n], n in m.assessed) for n in m.order]
            yield pd.DataFrame(rows, columns=["learner", "g", "n", "belief", "assessed"])

    kind = responses.schema["learner"].dataType.simpleString()
    out = each.mapInPandas(run, f"learner {kind}, g string, n string, belief double, assessed boolean")
    return out.select("learner", "g", "n", F.col("belief").cast("int").alias("place")) if probe_count else out.withColumn("belief", F.round("belief", 6))


def clean_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with id and title, defaults filled (level 2, obscurity 3), unknown and self prerequisites dropped."""
    ok = nodes.where("id IS NOT NULL AND id <> '' AND title IS NOT NULL AND title <> ''")
    known = ok.select("g", F.col("id").alias("p")).distinct()
    wanted = ok.select("g", "id", F.posexplode("prerequisites").alias("pos", "p")).where("p <> id").join(known, ["g", "p"])
    kept = wanted.groupBy("g", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "p"))), lambda s: s["p"]).alias("kept"))
    out = ok.drop("prerequisites").join(kept, ["g", "id"], "left")
    return out.withColumn("prerequisites", F.coalesce("kept", F.array().cast("array<string>"))).drop("kept").fillna({"level": 2, "obscurity": 3})


def break_cycles(edges: DataFrame) -> DataFrame:
    """``g, p, c`` without cycles: each round every cyclic component's greatest node gives up its greatest cyclic prerequisite.

    A component is what lies on cycles through one another (strongly connected).  Each round removes
    a link of every one of them, so the rounds end when no node lies on a cycle.
    """
    from quern.operators.hierarchy import ancestors
    from quern.session import cut

    live = cut(edges.select("g", "p", "c").distinct())
    while True:
        up = cut(ancestors(live))
        back = up.select("g", F.col("a").alias("d"), F.col("d").alias("a"))
        # of nodes above each other, the greatest names the component
        part = cut(up.join(back, ["g", "a", "d"]).groupBy("g", F.col("a").alias("c")).agg(F.max("d").alias("s")))
        if part.isEmpty():
            return live
        inner = live.join(part, ["g", "c"]).join(part.select("g", F.col("c").alias("p"), "s"), ["g", "p", "s"])
        last = inner.groupBy("g", "s").agg(F.max(F.struct("c", "p")).alias("x")).select("g", "x.p", "x.c")
        live = cut(live.join(last, ["g", "p", "c"], "left_anti"))


def probe_kind(asked: Column, candidates: Column, belief: Column) -> Column:
    """How the next question is put: recognition first, every fourth a comparison, scoping where the node is likely known."""
    return F.when(asked < 3, "recognition").when((asked % 4 == 0) & (candidates >= 2), "comparison").when(belief > 0.6, "scoping").otherwise("recognition")


def outline(nodes: DataFrame) -> DataFrame:
    """``g, outline``: titles indented by level, in level and id order."""
    line = F.concat(F.repeat(F.lit("  "), F.coalesce("level", F.lit(2)) - 1), F.lit("- "), "title")
    return nodes.groupBy("g").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("level", "id", line.alias("line")))), lambda s: s["line"])).alias("outline"))
