"""Variant spellings of typed names: trie join with Levenshtein automata and token-order checks.

Tokens of the catalogue's names are sharded into tries.  Each token of a mention walks the trie
under a Levenshtein automaton (its states are the rows of the edit table; swapped neighbours count
once), which enumerates the tokens within the bounded distance.  The entities that own a distinctive
token so found are candidates; a candidate is accepted if the mention's tokens, in any order, can be
assigned to its own: equal, within the distance, as a nickname or a short form, as an initial or as an abbreviation.
A shared name part is not enough: every token of the mention must find its place, and the entity's
distinctive parts must be covered.  Where that links nothing, blanks may be lost: pieces of the mention's
tokens are looked up instead, in any number.  What the indexes reach equals a comparison with every entity.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHARD = 5000  #: catalogue entities in one trie
CHUNK = 1000  #: distinct mentions that one task links against one trie
SEARCHED = 12  #: tokens up to which an assignment is searched; longer ones are solved in polynomial time
GENERIC_SHARE = 0.003  #: tokens in more than this share of the names (and more than 6) are generic words

# Letters that Unicode doesn't decompose.
_LETTERS = str.maketrans({"ø": "o", "æ": "ae", "œ": "oe", "ß": "ss", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i"})
# Characters that scanners and hasty fingers put for letters.
_DIGITS = str.maketrans({"0": "o", "1": "l", "3": "e", "5": "s", "8": "b", "|": "l"})
# Titles and words that carry no name.
TITLES = frozenset("dr mr mrs ms miss prof professor sir dame rev revd fr hon st jr sr phd md esq herr frau mme".split())
STOP = frozenset("the of for in and at an de la le du der die das und et".split())  # "des" is a nickname too
# Abbreviations of words in names of organisations.
ABBREVIATIONS = {
    "inst": "institute", "univ": "university", "uni": "university", "u": "university", "soc": "society", "lib": "library", "pub": "public", "arch": "archive",
    "archives": "archive", "ltd": "limited", "co": "company", "corp": "corporation", "inc": "incorporated", "assn": "association", "assoc": "association",
    "dept": "department", "natl": "national", "intl": "international", "fdn": "foundation", "mus": "museum", "acad": "academy", "coll": "college", "hist": "history",
}
# Everyday short forms of given names that don't begin like them; those that do need no list, and
# others are learned from the catalogue's aliases.
NICKNAMES = {
    "andrew": "drew", "anthony": "tony", "antonia": "toni", "charles": "chuck carl", "dorothea": "thea", "dorothy": "dot dolly", "edward": "ted ned", "eleanor": "nell nora", "elizabeth": "beth betty libby lisa", "eugene": "gene",
    "florence": "flo", "frances": "fran franny", "frederick": "rick", "gerald": "jerry", "gertrude": "trudy", "helen": "nell lena", "henry": "hank harry", "james": "jim jimmy", "jane": "jenny", "joan": "jo", "john": "jack johnny",
    "katherine": "kit kitty", "lawrence": "larry", "margaret": "peggy greta daisy", "martha": "patty", "mary": "molly polly", "matilda": "tilly", "michael": "mick mike", "patrick": "paddy", "rebecca": "becky", "richard": "dick",
    "robert": "bob bobby", "rosamund": "roz", "sarah": "sally", "stephen": "steve", "susanna": "sue", "theodore": "ted", "theresa": "tess", "walter": "wally", "william": "bill billy liam",
}
SHORT = 3  #: letters of a short form that begins like the name

_TOKEN = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Lower case without accents, ``&`` and ``+`` spelled out."""
    t = unicodedata.normalize("NFKD", text.casefold()).translate(_LETTERS)
    t = "".join(c for c in t if not unicodedata.combining(c))
    return re.sub(r"[&+]", " and ", re.sub(r"['’`]", "", t))


def tokens(text: str) -> list[str]:
    """Name tokens: folded, titles and stop words left out, digits inside words read as letters."""
    out = []
    for t in _TOKEN.findall(fold(text)):
        if any(c.isalpha() for c in t):
            t = t.translate(_DIGITS)
        if t not in STOP and t not in TITLES:
            out.append(t)
    return out


def bound(token: str) -> int:
    """Edit distance allowed for a token."""
    return 0 if len(token) < 4 else 1 if len(token) < 7 else 2


_BOUNDS = [bound("x" * n) for n in range(8)]  # by length; longer ones are as 7


class Trie:
    """Trie of tokens; ``near`` enumerates those within an edit distance (swaps count once)."""

    def __init__(self, words: Iterable[str]):
        self.root: dict = {}
        self.longest = 0
        for w in words:
            self.longest = max(self.longest, len(w))
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w

    def near(self, word: str, most: int) -> list[tuple[str, int]]:
        found: list[tuple[str, int]] = []
        n = len(word)
        if n > self.longest + most:  # longer than anything within the distance
            return found
        stack = [(self.root, "", list(range(n + 1)), None)]
        while stack:
            node, last, row, before = stack.pop()
            end = node.get("")
            if end is not None and row[n] <= most:
                found.append((end, row[n]))
            for c, child in node.items():
                if not c:
                    continue
                new = [row[0] + 1]
                best = new[0]
                for i in range(1, n + 1):
                    ch = word[i - 1]
                    v = row[i - 1] if ch == c else 1 + min(row[i - 1], row[i], new[i - 1])
                    if before is not None and i > 1 and ch == last and word[i - 2] == c:
                        v = min(v, before[i - 2] + 1)
                    new.append(v)
                    if v < best:
                        best = v
                if best <= most or min(row) < most:
                    stack.append((child, c, new, row))
        return found

    def starts(self, text: str) -> list[tuple[int, str, int]]:
        """Words that pieces from the start of ``text`` are within the bound of: length of the piece, word, distance."""
        found: list[tuple[int, str, int]] = []
        n, most = len(text), bound("x" * len(text))
        far = [most + 1] * (n + 1)
        stack = [(self.root, "", 0, list(range(n + 1)), far)]
        while stack:
            node, last, depth, row, before = stack.pop()
            end = node.get("")
            if end is not None:
                found += [(i, end, row[i]) for i in range(max(1, depth - most), min(n, depth + most) + 1) if row[i] <= _BOUNDS[min(i, 7)]]
            depth += 1
            band = range(max(1, depth - most), min(n, depth + most) + 1)
            for c, child in node.items():
                if not c:
                    continue
                new = far[:]  # cells off the band are farther than any bound
                new[0] = best = depth
                for i in band:
                    ch = text[i - 1]
                    v = row[i - 1] if ch == c else 1 + min(row[i - 1], row[i], new[i - 1])
                    if i > 1 and ch == last and text[i - 2] == c:
                        v = min(v, before[i - 2] + 1)
                    new[i] = v
                    if v < best:
                        best = v
                if best <= most or min(row) < most:
                    stack.append((child, c, depth, new, row))
        return found


def _hungarian(grid: list[list[float | None]]) -> tuple[float, set[int]] | None:
    """Cheapest assignment of every row to a column of its own; None marks a pair that can't be."""
    never = 1e6
    rows, columns = len(grid), len(grid[0]) if grid else 0
    if rows > columns:
        return None
    u, v, owner, back = [0.0] * (rows + 1), [0.0] * (columns + 1), [0] * (columns + 1), [0] * (columns + 1)
    for i in range(1, rows + 1):
        owner[0], at = i, 0
        least, done = [float("inf")] * (columns + 1), [False] * (columns + 1)
        while owner[at]:
            done[at] = True
            row, step, to = owner[at], float("inf"), 0
            for k in range(1, columns + 1):
                if not done[k]:
                    c = grid[row - 1][k - 1]
                    cost = (never if c is None else c) - u[row] - v[k]
                    if cost < least[k]:
                        least[k], back[k] = cost, at
                    if least[k] < step:
                        step, to = least[k], k
            for k in range(columns + 1):
                if done[k]:
                    u[owner[k]] += step
                    v[k] -= step
                else:
                    least[k] -= step
            at = to
        while at:
            owner[at] = owner[back[at]]
            at = back[at]
    chosen = [(grid[owner[k] - 1][k - 1], k - 1) for k in range(1, columns + 1) if owner[k]]
    return None if any(c is None for c, _ in chosen) else (sum(c for c, _ in chosen), {k for _, k in chosen})


class Linker:
    """Links mentions to the entities of one shard; built once a task."""

    def __init__(self, rows: pd.DataFrame, generic: frozenset[str], nicknames: dict[str, frozenset[str]]):
        self.generic, self.nick = generic, nicknames
        self.entity: list[tuple[str, bool, list[list[str]]]] = []
        owners: dict[str, set[int]] = defaultdict(set)
        acronyms: dict[str, set[int]] = defaultdict(set)
        derived: dict[str, set[int]] = defaultdict(set)
        self.exact: dict[tuple[str, ...], set[int]] = defaultdict(set)
        for qid, label, aliases, kind in zip(rows["qid"], rows["label"], rows["aliases"], rows["kind"]):
            human, me = kind == "human", len(self.entity)
            forms: list[list[str]] = []
            short = set()
            for f in [label, *(aliases if aliases is not None else [])]:
                if not f:
                    continue
                t = [x if human else ABBREVIATIONS.get(x, x) for x in tokens(f)]
                if not human and len(t) == 1 and f.isupper():
                    short.add(t[0])
                elif t and t not in forms:
                    forms.append(t)
            if not forms and not short:
                continue
            self.entity.append((qid, human, forms))
            for x in short:
                acronyms[x].add(me)
            for t in forms:
                self.exact[tuple(sorted(t))].add(me)
                own = t[-1:] if human else [x for x in t if len(x) > 1 and x not in generic]
                for x in own or [max(t, key=len)]:  # generic words only: all of them must be found, so one leads there
                    owners[x].add(me)
            if not human and forms and len(forms[0]) >= 3:
                derived["".join(x[0] for x in forms[0])].add(me)
        self.owners, self.acronyms, self.derived = dict(owners), dict(acronyms), dict(derived)
        self.known = set(generic) | set(nicknames) | set(ABBREVIATIONS) | {x for _, _, fs in self.entity for f in fs for x in f if len(x) > 1}
        self.words = Trie(x for x in self.known if len(x) > 1)
        self.most = max((len(f) for _, _, fs in self.entity for f in fs), default=0)
        self.begun: dict[str, list[tuple[int, str, int]]] = {}
        self.seen: dict[str, dict[str, int]] = {}

    def close(self, token: str) -> dict[str, int]:
        """Known tokens within the bound of ``token``, with their distance."""
        known = self.seen.get(token)
        if known is None:
            known = self.seen[token] = dict(self.words.near(token, bound(token)))
        return known

    def _cost(self, m: str, e: str, human: bool, place: int, last: int, alias: bool = False) -> float | None:
        """Cost of reading the mention's token ``m`` as the entity's ``e``; None if it can't be.

        Initials of persons are read by the label, which spells the names out; in an alias they stand for themselves.
        """
        if m == e:
            return 0.0
        if len(m) == 1:
            return 0.3 if human and not alias and place != last and e[0] == m else None
        if not human:
            a = ABBREVIATIONS.get(m)
            if a == e:
                return 0.1
        elif place != last:
            if e in self.nick.get(m, ()):
                return 0.2
            if SHORT <= len(m) < len(e) and e.startswith(m):
                return 0.25
            if len(e) == 1:
                return 0.3 if m[0] == e and not alias else None
        d = self.close(m).get(e)
        if d is not None and d:
            return 0.5 * d
        if human and place != last and len(m) > 4:
            steps = [k for w, k in self.close(m).items() if e in self.nick.get(w, ())]
            if steps:
                return 0.2 + 0.5 * min(steps)
        if not human and len(m) > 3 and m in ABBREVIATIONS.values():
            return None
        return None

    def _assign(self, m: list[str], e: list[str], human: bool, need: set[int], alias: bool = False) -> float | None:
        """Cost of the cheapest assignment of all of ``m`` to different tokens of ``e``, in any order, that covers ``need``.

        Initials of a person that are more than the label's tokens may stand for names it lacks.
        """
        last = len(e) - 1
        spare = max(0, len(m) - len(e)) if human and not alias else 0
        grid = [[self._cost(x, y, human, k, last, alias) for k, y in enumerate(e)] + [0.4 if len(x) == 1 else None] * spare for x in m]
        if len(m) > SEARCHED:
            prize = len(m) + 2.0 * sum(map(len, m))  # more than any assignment costs
            got = _hungarian([[c if c is None or k not in need else c - prize for k, c in enumerate(row)] for row in grid])
            return got[0] + prize * len(need) if got is not None and need <= got[1] else None
        best: list = [None]
        must = sum(1 << k for k in need)

        def go(i: int, used: int, cost: float) -> None:
            if best[0] is not None and cost >= best[0]:
                return
            if i == len(m):
                if used & must == must:
                    best[0] = cost
                return
            for k, c in enumerate(grid[i]):
                if c is not None and not used >> k & 1:
                    go(i + 1, used | 1 << k, cost + c)

        go(0, 0, 0.0)
        return best[0]

    def match(self, mention: str) -> list[tuple[float, str]]:
        """Accepted entities with their costs, cheapest first."""
        raw = tokens(mention)
        if not raw:
            return []
        same = self.exact.get(tuple(sorted(raw)))
        out: dict[int, float] = {i: 0.0 for i in same} if same else {}
        letters = "".join(raw)
        if not out and (len(raw) == 1 or all(len(x) == 1 for x in raw)):
            out = {i: 0.45 for i in self.derived.get(letters, ())} | {i: 0.4 for i in self.acronyms.get(letters, ())}  # given ones win, in any shard
        if not out:
            self._candidates(raw, out)
        if not out:
            self._glued(raw, out)
        return sorted((c, self.entity[i][0]) for i, c in out.items())

    def _candidates(self, m: list[str], out: dict[int, float]) -> None:
        near: set[int] = set()
        for t in m:
            for x in (t, ABBREVIATIONS.get(t), *self.close(t)):
                near |= self.owners.get(x, set())
        for i in near:
            _, human, forms = self.entity[i]
            for at, f in enumerate(forms):
                cost = self._accept(m, f, human, human and at > 0)
                if cost is not None:
                    out[i] = min(cost, out.get(i, 9.0))

    def _starts(self, text: str) -> list[tuple[int, str, int]]:
        text = text[: self.words.longest + 2]  # no piece within a bound is longer
        known = self.begun.get(text)
        if known is None:
            known = self.begun[text] = self.words.starts(text)
        return known

    def _glued(self, m: list[str], out: dict[int, float]) -> None:
        """Readings of a mention whose blanks were lost: any of its tokens may be several of an entity's, stop words between.

        Entities that own a known piece are tried; for each, a table over places in the tokens keeps the cheapest
        reading of every set of its tokens, so neither pieces nor glued tokens are limited.
        """
        reach = self.words.longest + 2
        for t in m:  # each piece is a token of the entity: no reading has more pieces than the longest name
            if len(t) > reach:
                fewest = [0] + [self.most + 1] * len(t)
                for i in range(len(t)):
                    if fewest[i] > self.most:
                        continue
                    for j in range(i + 1, min(i + reach, len(t)) + 1):
                        fewest[j] = min(fewest[j], fewest[i] + 1)
                    for w in STOP:
                        if t.startswith(w, i):
                            fewest[i + len(w)] = min(fewest[i + len(w)], fewest[i])
                if fewest[-1] > self.most:
                    return
        near: set[int] = set()
        pieces = []
        for t in m:
            at = [self._starts(t[i:]) for i in range(len(t))]
            pieces.append(at)
            for w in {*t, *(x for ends in at for _, x, _ in ends)}:
                near |= self.owners.get(w, set()) | self.owners.get(ABBREVIATIONS.get(w, ""), set())
        for i in near:
            _, human, forms = self.entity[i]
            for at, f in enumerate(forms):
                cost = self._read(m, pieces, f, human, human and at > 0)
                if cost is not None:
                    out[i] = min(cost + 0.3, out.get(i, 9.0))

    def _steps(self, t: str, pieces: list, e: list[str], human: bool, alias: bool) -> list[list[tuple[int, int, float]]]:
        """From each place in a token: the end of a piece, the entity's token that it is read as (-1: none), the cost.

        A piece isn't read as a word that the whole token is as near to: half a surname is no initial and surname.
        """
        n, last = len(t), len(e) - 1
        whole = self.close(t)
        steps: list[list[tuple[int, int, float]]] = [[] for _ in t]
        for k, y in enumerate(e):
            c = self._cost(t if human or len(t) == 1 else ABBREVIATIONS.get(t, t), y, human, k, last, alias)
            if c is not None:
                steps[0].append((n, k, c))
        places: dict[str, list[int]] = defaultdict(list)
        for k, y in enumerate(e):
            places[y].append(k)
        for i in range(n):
            for size, w, d in pieces[i]:
                if size == n or whole.get(w, 9) <= d:
                    continue
                to = i + size
                steps[i] += [(to, k, 0.5 * d) for k in places.get(w, ())]
                if not human:
                    steps[i] += [(to, k, 0.0) for k in places.get(ABBREVIATIONS.get(w, "") if not d else "", ())]
                    continue
                for y in self.nick.get(w, ()) if not d or size > 4 else ():
                    steps[i] += [(to, k, 0.2 + 0.5 * d) for k in places.get(y, ()) if k != last]
                if not d and not alias:
                    steps[i] += [(to, k, 0.3) for k in places.get(w[0], ()) if k != last]
            if n > 1:
                for k, y in enumerate(e):
                    if y == t[i]:
                        steps[i].append((i + 1, k, 0.0))
                    elif human and k != last and y[0] == t[i]:
                        if not alias:
                            steps[i].append((i + 1, k, 0.3))
                        for size in range(2, min(len(y), n - i + 1, n)):
                            if t[i + size - 1] != y[size - 1]:
                                break
                            if size >= SHORT:
                                steps[i].append((i + size, k, 0.25))
                steps[i] += [(i + len(w), -1, 0.0) for w in STOP if i + len(w) < n and t.startswith(w, i)]  # none at the end: surnames end so
        return steps

    def _read(self, m: list[str], pieces: list, e: list[str], human: bool, alias: bool) -> float | None:
        """Cost of the cheapest accepted reading of the glued tokens as the entity's; initials of lacking names stand alone."""
        size = len(e)
        states: dict[tuple[int, int], float] = {(0, 0): 0.0}  # tokens of the entity used, initials of lacking names: cost
        ways = [self._steps(t, at, e, human, alias) for t, at in zip(m, pieces)]
        need = self._need(e, human)
        if not need <= {k for steps in ways for here in steps for _, k, _ in here}:
            return None
        for t, steps in zip(m, ways):
            # with what the token holds so far: 0 no piece, 1 one, 2 one spelled exactly behind stop words, 3 two or the whole
            table: list[dict[tuple[int, int, int], float]] = [{(used, spare, 0): c for (used, spare), c in states.items()}] + [{} for _ in t]
            for i, here in enumerate(table[:-1]):
                for (used, spare, held), cost in here.items():
                    for to, k, c in steps[i]:
                        if k < 0:
                            key = (used, spare, held)
                        elif used >> k & 1:
                            continue
                        else:
                            key = (used | 1 << k, spare, 3 if held or to - i == len(t) else 1 if c else 2)
                        if cost + c < table[to].get(key, 1e9):
                            table[to][key] = cost + c
            ends: dict[tuple[int, int], float] = {}
            for (used, spare, held), cost in table[-1].items():
                if held > 1:
                    ends[used, spare] = min(cost, ends.get((used, spare), 1e9))
            if human and not alias and len(t) == 1:
                for (used, spare), cost in states.items():
                    if spare < size:
                        ends[used, spare + 1] = min(cost + 0.4, ends.get((used, spare + 1), 1e9))
            states = ends
            if not states:
                return None
        must = sum(1 << k for k in need)
        best = None
        for (used, spare), cost in states.items():
            found = used.bit_count()
            if used & must != must or found + spare < 2 or (spare and (found < size or size < 2)):
                continue
            cost += (0.05 if human else 0.2) * (size - found)
            best = cost if best is None else min(best, cost)
        return best

    def _need(self, e: list[str], human: bool) -> set[int]:
        """A person's first and last name, an organisation's distinctive words; all of a name without such words."""
        if human:
            return {0, len(e) - 1}
        return {k for k, x in enumerate(e) if x not in self.generic} or set(range(len(e)))

    def _accept(self, m: list[str], e: list[str], human: bool, alias: bool = False) -> float | None:
        if human:
            extra = max(0, len(m) - len(e))
            # the catalogue may lack the middle names that initials stand for: as many as the name has parts, at most
            if len(m) < 2 or extra > len(e) or extra > sum(len(x) == 1 for x in m) or (extra and (len(e) < 2 or alias)):
                return None
            got = self._assign(m, e, True, self._need(e, True), alias)
            return None if got is None else got + 0.05 * max(0, len(e) - len(m))
        m = [ABBREVIATIONS.get(x, x) if len(x) > 1 else x for x in m]
        if len(m) > len(e) or len(m) < 2:
            return None
        got = self._assign(m, e, False, self._need(e, False))
        return None if got is None else got + 0.2 * (len(e) - len(m))


def _learn(catalogue: DataFrame) -> tuple[frozenset[str], DataFrame, int]:
    """Generic words of the whole catalogue, bounded by their least support; short forms that aliases show, as a table; the size."""

    def words(batches):
        for b in batches:
            seen: Counter = Counter()
            for label, kind in zip(b["label"], b["kind"]):
                seen.update(set(ABBREVIATIONS.get(x, x) for x in tokens(label or "")) if kind != "human" else ())
            yield pd.DataFrame(seen.items(), columns=["a", "n"])

    def pairs(batches):
        for b in batches:
            found = set()
            for label, aliases in zip(b["label"], b["aliases"]):
                t = tokens(label or "")
                for u in (tokens(a or "") for a in (aliases if aliases is not None else ())):
                    if len(t) > 1 and len(u) > 1 and t[-1] == u[-1] and len(u[0]) > 1 and u[0] not in t:
                        found.add((u[0], t[0]))
            yield pd.DataFrame(sorted(found), columns=["short", "name"])

    size = catalogue.count()
    counted = catalogue.mapInPandas(words, "a string, n long").groupBy("a").agg(F.sum("n").alias("n"))
    generic = frozenset(ABBREVIATIONS.values()) | {r["a"] for r in counted.where(F.col("n") >= max(7.0, GENERIC_SHARE * size)).collect()}
    return generic, catalogue.where("kind = 'human'").mapInPandas(pairs, "short string, name string").distinct(), size


def _names(batches):
    """Names of persons in the catalogue, by shard."""
    for b in batches:
        found = {(s, x) for s, label, aliases in zip(b["shard"], b["label"], b["aliases"]) for f in [label, *(aliases if aliases is not None else [])] for x in tokens(f or "")}
        yield pd.DataFrame(sorted(found), columns=["shard", "name"])


def link(mentions: DataFrame, catalogue: DataFrame, key: str = "res_id", mention: str = "mention") -> DataFrame:
    """``key, qid, cost``: each mention that names an entity of the catalogue, with that entity.

    Equal mentions are linked once.  The cheapest entity wins; if two entities cost the same the
    mention is ambiguous and stays unlinked.  Null, empty and blank mentions, null labels and empty
    tables link nothing; null or empty aliases are no forms; a row given twice counts once.
    """
    kind = F.lower(F.trim(F.coalesce("type_hint", F.lit(""))))
    names = catalogue.where("qid IS NOT NULL").select("qid", "label", "aliases", kind.alias("kind")).dropDuplicates(["qid"])
    generic, pairs, size = _learn(names)
    asked = mentions.select(F.trim(F.lower(mention)).alias("mention")).where("mention <> ''").groupBy("mention").agg(F.count("*").alias("n"))
    shards, chunks = max(1, ceil(size / SHARD)), max(1, ceil(asked.count() / CHUNK))
    left = asked.select("mention", F.pmod(F.xxhash64("mention"), F.lit(chunks)).alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    sharded = names.select("*", F.pmod(F.xxhash64("qid"), F.lit(shards)).cast("int").alias("shard"))
    # a shard gets the short forms of its own names, however few aliases show them; they have no qid
    short = sharded.where("kind = 'human'").mapInPandas(_names, "shard int, name string").distinct().join(pairs, "name")
    short = short.select(F.lit(None).cast("string").alias("qid"), F.col("name").alias("label"), F.array("short").alias("aliases"), F.lit("").alias("kind"), "shard")
    right = sharded.unionByName(short).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"))

    def run(ask: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        if not len(ask) or not len(have):
            return pd.DataFrame(columns=["mention", "qid", "cost"])
        nick = defaultdict(set)
        for full, shorts in NICKNAMES.items():
            for s in shorts.split():
                nick[s].add(full)
        for full, (s,) in zip(have["label"][have["qid"].isna()], have["aliases"][have["qid"].isna()]):
            nick[s].add(full)
        linker = Linker(have[have["qid"].notna()].sort_values("qid"), generic, {k: frozenset(v) for k, v in nick.items()})
        rows = [(m, q, c) for m in ask["mention"] for c, q in linker.match(m)[:3]]  # below, two over all shards decide
        return pd.DataFrame(rows, columns=["mention", "qid", "cost"])

    spread = left.repartition(max(chunks * shards, 1), "shard", "chunk") if chunks * shards > 1 else left
    found = spread.groupBy("shard", "chunk").cogroup(right.groupBy("shard", "chunk")).applyInPandas(run, "mention string, qid string, cost double")
    order = Window.partitionBy("mention").orderBy("cost", "qid")
    best = found.select("*", F.row_number().over(order).alias("place"), F.lead("cost").over(order).alias("next")).where("place = 1 AND (next IS NULL OR next > cost + 0.01)")
    rows = mentions.select(F.col(key).alias("key"), F.trim(F.lower(mention)).alias("mention")).where("key IS NOT NULL AND mention <> ''")
    return rows.join(best.select("mention", "qid", "cost"), "mention").groupBy(F.col("key").alias(key), "qid").agg(F.min("cost").alias("cost"))
