"""Personal data by candidate generation and gradient-boosted selection, all in SQL.

Base kinds follow fixed formats and always stay.  Beside them, high-recall
generators, one a kind, propose overlapping spans: every range of digit groups in
a number, hexadecimal and mixed runs, what follows a word like "password",
account numbers, disguised addresses.  Boosted trees read each candidate's format
and the 24 characters before it.  Of those above their kind's threshold that
touch no base span, the best score stays where some overlap.

The trees are fit in numpy on the candidates that the same SQL proposes on
``examples`` generated sentences with known private spans among look-alikes
(dates, sums, versions, checksums, names); every fourth sentence is held out and
sets the thresholds.  They become one SQL expression; documents never leave the
JVM.  Bounds in the patterns are those of the formats: 64 characters before an
address's mark, 34 in an account number, 43 in a written number.

Offsets are code points, ends exclusive.  ``split`` gives the gaps between
matches and ``regexp_extract_all`` the matches, so a running length gives every
offset in one fold by blocks.  Patterns are possessive and start only where a run
starts, which keeps them linear and the stack flat on texts of any length.
Overlaps are settled within runs of spans that touch one another: work grows with
a text's length, and with the square of such a run only.

Defined results: a null text is empty; an empty text has no spans; repeated
rows each get their row; further columns are ignored (kept by ``redact``).
"""

from __future__ import annotations

import json
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
EXTRA = ("secret", "account", "address", "number", "key", "password")
#: The base formats, possessive; a match may only start where its run does or where the last match ended.
PATTERN = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a match; most texts are skipped by it.
NEEDS = {"email": "contains({t}, '@')", "ip": "{t} rlike '[0-9][.][0-9]'", "card": "{t} rlike '[0-9][ -]?[0-9][ -]?[0-9]'", "phone": "contains({t}, '+')"}
#: A generator a kind; what they propose may overlap.  That of numbers looks ahead from the start of every group of digits.
CANDIDATES = {
    "secret": r"(?<![0-9A-Za-z])[0-9A-Fa-f]{24,}+(?![0-9A-Za-z])",
    "account": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+(?![0-9A-Za-z])",
    "address": r"(?<![0-9A-Za-z])[A-Za-z0-9._%+-]{1,64}+\x20?[(\[]at[)\]]\x20?[A-Za-z0-9.-]{1,80}+",
    "key": r"(?<![0-9A-Za-z_/+-])(?=[a-z_+-]{0,60}[0-9A-Z][a-z_+-]{0,60}[0-9A-Z])[0-9A-Za-z_+-]{16,}+(?![0-9A-Za-z/])",
    "password": r"[:=](?<=(?i:word|passwd|pwd|wort|passe|contraseña|secret|token|key)\x20?[:=])\x20?[\"']?[^\s\"',;]{5,}[^\s\"',;.:]",
    "number": r"(?<![0-9A-Za-z])(?=(\+?[0-9][0-9\x20().-]{5,42}[0-9](?![0-9A-Za-z])))",
}
_LONGEST = 43
_BLOCK = 1024
FEATURES = ("kind", "digits", "size", "marks", "letters", "upper", "turns", "hex", "luhn", "at", "say_call", "say_card", "say_secret", "say_id", "leading", "cut", "dated")
_WORDS = {"say_call": "tel|phone|call|mobil|fax", "say_card": "card|carte|tarjeta|karte|visa", "say_secret": "token|secret|key|passw|pwd|api|contrase|passe", "say_id": "ssn|iban|account|passport|konto|cuenta|compte"}


def _told(before: str) -> str:
    """SQL: an int with a bit for each group of words that ``before`` holds."""
    bits = " + ".join(f"if(b rlike '{v}', {1 << i}, 0)" for i, v in enumerate(_WORDS.values()))
    return f"element_at(transform(array(lower({before})), b -> {bits}), 1)"


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _scan(items: str, state: dict[str, str], step: dict[str, str], made: str, kind: str, block: int = 256) -> str:
    """SQL: the array of what a fold over ``items`` makes, one element of type ``kind`` an item.

    ``state`` names the first values, ``step`` the next ones and ``made`` the
    element, from the state ``a`` before the item ``x``.  An array that grows
    in a fold is copied at each item, so the fold goes by blocks: a block's own
    array never holds more than ``block`` elements.
    """
    values = lambda of: ", ".join(f"'{k}', {v}" for k, v in of.items())
    cut = f"element_at(transform(array({items}), p -> transform(sequence(0, (size(p) - 1) div {block}), b -> slice(p, cast(b * {block} + 1 as int), {block}))), 1)"
    one = f"aggregate(b, named_struct({values({k: f'w.{k}' for k in state})}, 'out', cast(array() as array<{kind}>)), (a, x) -> named_struct({values(step)}, 'out', array_append(a.out, {made})))"
    held = values({k: f"r.{k}" for k in state})
    return (
        f"aggregate({cut}, named_struct({values(state)}, 'out', cast(array() as array<array<{kind}>>)), "
        f"(w, b) -> element_at(transform(array({one}), r -> named_struct({held}, 'out', array_append(w.out, r.out))), 1), w -> flatten(w.out))"
    )


def _found(text: str, pattern: str) -> str:
    """SQL: array of (s, e, m, before, after) of the matches of ``pattern`` in ``text``."""
    p = _lit(pattern)
    pairs = f"element_at(transform(array(struct(split({text}, {p}, -1) as gaps, regexp_extract_all({text}, {p}, 0) as hits)), t -> zip_with(slice(t.gaps, 1, size(t.hits)), t.hits, (g, m) -> struct(g, m))), 1)"
    start = "a.at + char_length(x.g)"
    made = f"named_struct('s', {start}, 'e', {start} + char_length(x.m), 'm', x.m, 'before', right(x.g, 24))"
    return _scan(pairs, {"at": "0"}, {"at": f"{start} + char_length(x.m)"}, made, "struct<s:int,e:int,m:string,before:string>")


def _proposed(text: str, kind: str) -> str:
    """SQL: array of (s, e, m, told, cut, g) that the generator of ``kind`` proposes.

    A number is proposed from the start of each group of digits to the end of
    each later group; ``cut`` marks that a sign joins it to further digits.
    ``told`` has a bit for each group of words in the 24 characters before.
    """
    p, ahead, whole = _lit(CANDIDATES[kind]), kind == "number", text
    none = "cast(array() as array<struct<s:int,e:int,m:string,told:int,cut:int,g:int>>)"
    only = lambda found: f"if({whole} rlike {p}, {found}, {none})"
    # a start without width is not split off at the very first character, hence the blank before the text
    text = f"concat(' ', {text})" if ahead else text
    pairs = f"element_at(transform(array(struct(split({text}, {p}, -1) as gaps, regexp_extract_all({text}, {p}, {int(ahead)}) as hits)), t -> zip_with(slice(t.gaps, 1, size(t.hits)), t.hits, (g, m) -> struct(g, m))), 1)"
    step = {"at": f"a.at + char_length(x.g) + {'0' if ahead else 'char_length(x.m)'}", "tail": f"right(concat(a.tail, x.g{'' if ahead else ', x.m'}), 24)"}
    made = f"named_struct('s', a.at + char_length(x.g), 'm', x.m, 'told', {_told('right(concat(a.tail, x.g), 24)')}, 'last', right(concat(a.tail, x.g), 1))"
    fold = _scan(pairs, {"at": "0", "tail": "''"}, step, made, "struct<s:int,m:string,told:int,last:string>")
    rank = EXTRA.index(kind)
    if kind == "password":  # what stands behind the sign; the words before it end in the sign
        value = "regexp_replace(x.m, '^ ?[:=] ?[\"\\']?', '')"
        return only(f"transform({fold}, x -> named_struct('s', x.s + char_length(x.m) - char_length({value}), 'e', x.s + char_length(x.m), 'm', {value}, 'told', x.told, 'cut', 0, 'g', {rank}))")
    if not ahead:
        return only(f"transform({fold}, x -> named_struct('s', x.s, 'e', x.s + char_length(x.m), 'm', x.m, 'told', x.told, 'cut', 0, 'g', {rank}))")
    ends = f"filter(sequence(7, greatest(7, least({_LONGEST}, char_length(x.m)))), j -> substring(x.m, j, 1) between '0' and '9' and not (substring(x.m, j + 1, 1) between '0' and '9'))"
    one = f"named_struct('s', x.s - 1, 'e', x.s - 1 + j, 'm', left(x.m, j), 'told', x.told, 'cut', if(x.last in ('-', '.', '/') or substring(x.m, j + 1, 2) rlike '^[.-][0-9]', 1, 0), 'g', {rank})"
    return only(f"flatten(transform({fold}, x -> transform({ends}, j -> {one})))")


def _luhn(digits: str) -> str:
    """SQL: whether a string of digits passes the Luhn sum."""
    d = f"reverse(split({digits}, ''))"
    return f"aggregate(transform({d}, (c, i) -> if(i % 2 = 0, cast(c as int), cast(floor(cast(c as int) * 2 / 10) as int) + (cast(c as int) * 2) % 10)), 0, (x, y) -> x + y) % 10 = 0"


def _kept(kind: str, spans: str) -> str:
    """SQL: the spans of a base kind whose match holds."""
    digits = "regexp_replace(x.m, '[^0-9]', '')"
    if kind == "ip":
        part = "regexp_replace(p, '^0+', '')"
        return f"filter({spans}, x -> forall(split(x.m, '[.]'), p -> char_length({part}) <= 3 and coalesce(try_cast(nullif({part}, '') as int), 0) <= 255))"
    if kind == "card":
        return f"filter({spans}, x -> {_luhn(digits)})"
    if kind == "phone":
        return f"filter({spans}, x -> char_length({digits}) between 8 and 15)"
    return spans


def _features(x: str) -> dict[str, str]:
    """SQL of each feature of candidate ``x`` as a double."""
    m = f"{x}.m"
    # a number holds digits and its signs alone, which spares most patterns
    number = f"{x}.g = {EXTRA.index('number')}"
    digits = f"if({number}, translate({m}, ' ().+-', ''), regexp_replace({m}, '[^0-9]', ''))"
    out = {
        "digits": f"char_length({digits})",
        "size": f"char_length({m})",
        "marks": f"if({number}, char_length({m}) - char_length({digits}), char_length(regexp_replace({m}, '[0-9A-Za-z]', '')))",
        "letters": f"if({number}, 0, char_length(regexp_replace({m}, '[^A-Za-z]', '')))",
        "kind": f"{x}.g",
        "upper": f"if({number}, 0, char_length(regexp_replace({m}, '[^A-Z]', '')))",
        "turns": f"if({number}, 0, size(regexp_extract_all({m}, '(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]', 0)))",
        "hex": f"if({m} rlike '^[0-9A-Fa-f]+$', 1, 0)",
        "luhn": f"if(char_length({digits}) between 12 and 19 and {_luhn(digits)}, 1, 0)",
        "at": f"if(not ({number}) and {m} rlike '[(\\\\[]at[)\\\\]]', 1, 0)",
        "cut": f"{x}.cut",
        "dated": f"if({m} rlike '(?<![0-9])([0-9]{{4}}[.-][0-9]{{1,2}}[.-][0-9]{{1,2}}|[0-9]{{1,2}}[.-][0-9]{{1,2}}[.-][0-9]{{4}})(?![0-9])', 1, 0)",
        "leading": f"if({m} like '+%' or {m} like '0%', 1, 0)",
    }
    out |= {k: f"if({x}.told & {1 << i} > 0, 1, 0)" for i, k in enumerate(_WORDS)}
    return {k: f"cast({out[k]} as double)" for k in FEATURES}


_SAID = {
    "call": ("call", "phone", "tel.", "Telefon", "mobile", "fax", "téléphone"),
    "card": ("card", "carte", "Karte", "tarjeta", "visa"),
    "secret": ("token =", "secret:", "api key", "key =", "password:", "passwd="),
    "id": ("account", "iban", "passport", "ssn", "Konto", "cuenta", "compte"),
    "none": ("the", "und", "sur", "para", "of", "is", "page", "total", "since", "le", "version", "in", "room", "chapter"),
}
_FILL = "the report of our market was sent when it rained and nobody knew why das Haus steht am Fluss la casa está cerca le jardin est grand".split()


def _sentences(n: int, seed: int = 17) -> list[dict]:
    """Generated texts, each with the (start, end) of its private spans; the rest only looks like them."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    dig, low, alnum = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def card(valid: bool) -> str:
        body = pick(dig, r.choice((12, 13, 14, 15)))
        total = sum(sum(map(int, str(int(c) * 2))) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body)))
        return body + str((-total + (0 if valid else r.randint(1, 9))) % 10)

    def call() -> str:
        parts = r.choice(((3, 4), (3, 3, 4), (2, 2, 2, 2, 2), (4, 7), (5, 6), (3, 7)))
        sep = r.choice((" ", "-", ".", " "))
        lead = r.choice(("", "0", "0"))
        return lead + sep.join(pick("123456789", 1) + pick(dig, k - 1) for k in parts)

    def private() -> tuple[str, str]:
        shape = r.choice(("hex", "key", "pass", "account", "at", "call", "card", "id"))
        if shape == "hex":
            return r.choice(("secret", "secret", "none")), (pick("0123456789abcdef", r.choice((32, 40, 64))) if r.random() < 0.7 else pick("0123456789ABCDEF", r.choice((32, 40))))
        if shape == "key":
            return r.choice(("secret", "none")), r.choice(("ghp_", "AKIA", "sk-", "xoxb-", "pk_live_", "", "")) + (pick(alnum, r.randint(20, 40)) if r.random() < 0.7 else r.choice((pick("0123456789abcdef", 36), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", r.randint(18, 30)))))
        if shape == "pass":
            return "secret", r.choice((pick(alnum + "!$%#", r.randint(8, 14)) + pick(dig, 1), pick(low, r.randint(4, 8)) + pick(dig, r.randint(1, 3)) + pick(low, r.randint(0, 3))))
        if shape == "account":
            return r.choice(("id", "none")), pick("DFEIG", 1) + pick("ERSTB", 1) + pick(dig, 2) + pick(dig, r.randint(12, 20))
        if shape == "at":
            return "none", pick(low, r.randint(3, 9)) + r.choice((" [at] ", "(at)", " (at) ", "[at]")) + pick(low, r.randint(4, 9)) + r.choice((".com", ".org", ".de"))
        if shape == "call":
            return "call", call()
        if shape == "card":
            return r.choice(("card", "none")), card(True)[-16:]
        return "id", pick(dig, 3) + "-" + pick(dig, 2) + "-" + pick(dig, 4) if r.random() < 0.5 else pick(dig, r.randint(8, 11))

    def alike(told: bool) -> str:
        """What is not private; after a word that tells of private data, a date or a span of years."""
        y, m, d = r.randint(1900, 2030), r.randint(1, 12), r.randint(1, 28)
        dates = (lambda: f"{y}-{m:02d}-{d:02d}", lambda: f"{d:02d}.{m:02d}.{y}", lambda: f"{d}-{m}-{y}", lambda: f"{y}-{y + 3}", lambda: " ".join(f"{y}-{m:02d}-{k:02d}" for k in range(d, d + r.randint(2, 3))))
        return r.choice(dates if told else (
            *dates, call, call, lambda: f"{r.randint(1, 999)}.{r.randint(100, 999)}.{r.randint(100, 999)}",
            lambda: pick(dig, r.randint(7, 20)), lambda: pick(low, r.randint(16, 30)), lambda: "_".join(pick(low, r.randint(3, 8)) for _ in range(4)), lambda: f"{pick(low, 7)}-{pick(low, 8)}-{y}",
            lambda: pick(low, 1).upper() + pick(low, r.randint(15, 30)), lambda: pick(low, r.randint(16, 24)).upper(), lambda: "".join(pick(low, 1).upper() + pick(low, r.randint(4, 9)) for _ in range(3)),
            lambda: pick(low, 12) + pick(dig, r.randint(1, 6)), lambda: pick(low, 1).upper() + pick(low, r.randint(5, 9)) + "-" + pick(low, 1).upper() + pick(low, r.randint(7, 12)), lambda: f"{r.randint(1, 20)}.{r.randint(0, 30)}.{r.randint(0, 99)}", lambda: f"({r.randint(1, 99)}) {r.randint(100, 9999)} {r.randint(1000, 9999)}",
            lambda: "-".join(pick("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)), lambda: pick(low, 9) + "at" + pick(low, 9), lambda: "-" * r.randint(16, 40), lambda: "_" * r.randint(16, 40), lambda: "key: " + pick(low, r.randint(4, 10)),
            lambda: r.choice(("ISBN ", "DOI ", "No. ")) + pick(dig, 13), lambda: card(False)[-16:], lambda: f"{pick(low, 5)} {r.randint(1, 12)}:{r.randint(10, 59)} - {r.randint(1, 12)}:{r.randint(10, 59)}",
        ))()

    out = []
    for _ in range(n):
        text, spans = " ".join(r.choice(_FILL) for _ in range(r.randint(2, 8))), []
        for _ in range(r.randint(1, 4)):
            if r.random() < 0.5:
                said, item = private()
                text += " " + r.choice(_SAID[said]) + (" " + alike(True) if said == "call" and r.random() < 0.3 else "") + " " + (quote := '"' * (said == "secret" and r.random() < 0.3))
                spans.append({"s": len(text), "e": len(text) + len(item)})
                text += item + quote
            else:
                said = r.choice(("none", "none", "none", "call", "card", "id"))
                text += " " + r.choice(_SAID[said]) + " " + alike(said != "none")
            text += r.choice((" ", ", ", ". ", " and ")) + " ".join(r.choice(_FILL) for _ in range(r.randint(1, 6)))
        out.append({"text": text, "own": spans})
    return out


def _examples(spark: SparkSession, examples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature rows of the candidates of generated texts, whether each is private, and (text, start, end)."""
    made = json.dumps([x | {"i": i} for i, x in enumerate(_sentences(examples))])
    rows = spark.range(1).select(F.explode(F.from_json(F.lit(made), "array<struct<i:int,text:string,own:array<struct<s:int,e:int>>>>")).alias("r")).select("r.*")
    named = ", ".join(f"'{k}', {v}" for k, v in _features("x").items())
    every = "concat(" + ", ".join(_proposed("text", k) for k in EXTRA) + ")"
    got = rows.select("i", F.expr(f"transform({every}, x -> named_struct('s', x.s, 'e', x.e, 'f', named_struct({named}), 'y', exists(own, o -> o.s = x.s and o.e = x.e)))").alias("c")).collect()
    flat = [(r["i"], c) for r in sorted(got, key=lambda r: r["i"]) for c in r["c"]]
    return np.array([[c["f"][k] for k in FEATURES] for _, c in flat]), np.array([float(c["y"]) for _, c in flat]), np.array([[i, c["s"], c["e"]] for i, c in flat])


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """A regression tree on gradients: (feature, cut, low, high) or a leaf value."""
    leaf = -g.sum() / (h.sum() + 1.0)
    if depth == 0 or len(g) < 20:
        return round(float(leaf), 6)
    best = (1e-6, None, None)
    whole = g.sum() ** 2 / (h.sum() + 1)
    for j in range(x.shape[1]):
        for cut in np.unique(x[:, j])[1:]:
            low = x[:, j] < cut
            gl, hl = g[low].sum(), h[low].sum()
            gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - whole
            if gain > best[0]:
                best = (gain, j, float(cut))
    _, j, cut = best
    if j is None:
        return round(float(leaf), 6)
    low = x[:, j] < cut
    return (j, cut, _tree(x[low], g[low], h[low], depth - 1), _tree(x[~low], g[~low], h[~low], depth - 1))


def _value(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    j, cut, low, high = tree
    return np.where(x[:, j] < cut, _value(low, x), _value(high, x))


_fit: dict[tuple, tuple[tuple, tuple[float, ...]]] = {}


def boosted(spark: SparkSession, examples: int = 1500, rounds: int = 20, depth: int = 4, rate: float = 0.5, precision: float = 0.97) -> tuple[tuple, tuple[float, ...]]:
    """Trees, and for each kind the least score at which precision reaches ``precision`` on held-out texts."""
    key = (examples, rounds, depth, rate, precision)
    if key not in _fit:
        x, y, at = _examples(spark, examples)
        hold = at[:, 0] % 4 == 0
        z, trees = np.full(len(y), 0.0), []
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-z))
            tree = _tree(x[~hold], rate * (p - y)[~hold], (p * (1 - p))[~hold], depth)
            trees.append(tree)
            z += _value(tree, x)
        # as they are chosen: where candidates overlap, the better score stands
        chosen: list[int] = []
        for i in sorted(np.flatnonzero(hold).tolist(), key=lambda i: (-round(z[i], 9), at[i, 1] - at[i, 2])):
            if not any(at[i, 0] == at[j, 0] and at[i, 1] < at[j, 2] and at[j, 1] < at[i, 2] for j in chosen):
                chosen.append(i)
        own = np.array(chosen)
        least = []
        for g in range(len(EXTRA)):
            mine = own[x[own, FEATURES.index("kind")] == g]
            right = np.cumsum(y[mine]) / np.arange(1, len(mine) + 1)
            enough = np.flatnonzero(right >= precision)
            least.append(max(0.0, float(z[mine[enough[-1]]])) if len(enough) else 1e9)
        _fit[key] = tuple(trees), tuple(least)
    return _fit[key]


def _tree_sql(tree, x: str) -> str:
    if not isinstance(tree, tuple):
        return f"{tree}D"
    j, cut, low, high = tree
    return f"if({x}.f.{FEATURES[j]} < {cut}D, {_tree_sql(low, x)}, {_tree_sql(high, x)})"


def _spans(docs: DataFrame) -> DataFrame:
    """``row`` (all columns of ``docs``), _email, _ip, _card, _phone (spans), _more (added spans with a kind) and _t, the text."""
    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("_t"))
    none = "cast(array() as array<struct<s:int,e:int,m:string,before:string>>)"
    for kind in BASE:
        found = _kept(kind, _found("_t", PATTERN[kind]))
        out = out.withColumn(f"_{kind}", F.expr(f"if({NEEDS[kind].format(t='_t')}, {found}, {none})"))
    trees, least = boosted(docs.sparkSession)
    bar = "element_at(array(" + ", ".join(f"{-v!r}D" for v in least) + "), x.g + 1)"
    named = ", ".join(f"'{k}', {v}" for k, v in _features("x").items())
    score = " + ".join(_tree_sql(t, "x") for t in trees)
    every = "concat(" + ", ".join(_proposed("_t", k) for k in EXTRA) + ")"
    proposed = "cast(array() as array<struct<s:int,e:int,m:string,told:int,cut:int,g:int>>)"
    out = out.withColumn("_cand", F.expr(f"if(_t rlike '[0-9]|[(\\\\[]at[)\\\\]]|[:=]|[0-9A-Za-z_+-]{{16}}', {every}, {proposed})"))
    # of one span, the most special kind: the first of its run in the order of place and kind
    ordered = "array_sort(transform(_cand, x -> named_struct('s', x.s, 'e', x.e, 'g', x.g, 'm', x.m, 'told', x.told, 'cut', x.cut)))"
    first = "if(a.s = x.s and a.e = x.e, a.k, x.g)"
    special = _scan(ordered, {"s": "-1", "e": "-1", "k": "0"}, {"s": "x.s", "e": "x.e", "k": first}, f"named_struct('k', {first}, 's', x.s, 'e', x.e, 'g', x.g, 'm', x.m, 'told', x.told, 'cut', x.cut)", "struct<k:int,s:int,e:int,g:int,m:string,told:int,cut:int>")
    scored = (
        f"filter(transform(transform({special}, x -> named_struct('k', x.k, 's', x.s, 'e', x.e, 'g', x.g, 'f', named_struct({named}))), "
        f"x -> named_struct('s', x.s, 'e', x.e, 'o', -({score}), 'g', x.g, 'k', x.k)), x -> x.o <= {bar})"
    )
    # base spans come before every score; a run of spans that touch one another is settled by itself, best score first, then the longer
    base = "transform(concat(_email, _ip, _card, _phone), x -> named_struct('s', x.s, 'e', x.e, 'o', -1e300D, 'g', -1, 'k', -1))"
    touching = {"run": "if(x.s < a.end, a.run, x.s)", "end": "greatest(a.end, x.e)"}
    runs = _scan(f"array_sort(concat({base}, {scored}))", {"run": "-1", "end": "-1"}, touching, f"named_struct('run', {touching['run']}, 'o', x.o, 'l', x.s - x.e, 'g', x.g, 's', x.s, 'e', x.e, 'k', x.k)", "struct<run:int,o:double,l:int,g:int,s:int,e:int,k:int>")
    here = "if(a.run = x.run, a.chosen, cast(array() as array<struct<s:int,e:int>>))"
    stays = f"x.k < 0 or not exists({here}, c -> c.s < x.e and x.s < c.e)"
    settled = _scan(f"array_sort({runs})", {"run": "-1", "chosen": "cast(array() as array<struct<s:int,e:int>>)"}, {"run": "x.run", "chosen": f"if({stays}, array_append({here}, named_struct('s', x.s, 'e', x.e)), {here})"}, f"named_struct('s', x.s, 'e', x.e, 'k', if({stays}, x.k, -1))", "struct<s:int,e:int,k:int>")
    name = "element_at(array(" + ", ".join(f"'{k}'" for k in EXTRA) + "), 1 + x.k)"
    more = f"if(size(_cand) = 0, cast(array() as array<struct<s:int,e:int,k:string>>), array_sort(transform(filter({settled}, x -> x.k >= 0), x -> named_struct('s', x.s, 'e', x.e, 'k', {name}))))"
    return out.withColumn("_more", F.expr(more)).select("row", *(f"_{k}" for k in BASE), "_more", "_t")


def _texts(spans: str, kind: str) -> str:
    return f"transform({spans}, x -> concat('{kind}:', x.s, ':', x.e))"


def find_private(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_more, n_spans) of every whole text; ``n_spans`` counts all spans."""
    found = _spans(docs.select("doc_id", "text"))
    base = "concat(" + ", ".join(_texts(f"_{k}", k) for k in BASE) + ")"
    more = "concat(" + ", ".join(f"transform(filter(_more, x -> x.k = '{k}'), x -> concat('{k}:', x.s, ':', x.e))" for k in EXTRA) + ")"
    return found.select(
        "row.doc_id",
        *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in BASE),
        F.expr(f"sha2(array_join({base}, ','), 256)").alias("base_sha256"),
        F.expr(f"array_join(concat({base}, {more}), ',')").alias("spans"),
        F.size("_more").cast("long").alias("n_more"),
        F.expr("cast(size(_email) + size(_ip) + size(_card) + size(_phone) + size(_more) as long)").alias("n_spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by its kind in brackets.

    Overlapping spans become one; ``n_chars``, where there is one, follows the
    new text.  A null text stays null.
    """
    found = _spans(docs)
    one = "concat(" + ", ".join(f"transform(_{k}, x -> named_struct('s', x.s, 'e', x.e, 'k', '{k}'))" for k in BASE) + ", transform(_more, x -> named_struct('s', x.s, 'e', x.e, 'k', x.k)))"
    # the text lies in blocks, so that no piece is counted off from the beginning; a span of no width ends it
    found = found.withColumn("_blocks", F.expr(f"regexp_extract_all(_t, '(?s).{{1,{_BLOCK}}}', 0)"))
    since, until = f"greatest(0, a.at - i * {_BLOCK})", f"least({_BLOCK}, x.s - i * {_BLOCK})"
    piece = f"if(a.at >= x.s, '', array_join(transform(sequence(a.at div {_BLOCK}, (x.s - 1) div {_BLOCK}), i -> substring(_blocks[i], cast({since} + 1 as int), cast({until} - {since} as int))), ''))"
    marked = f"array_append(array_sort({one}), named_struct('s', char_length(_t), 'e', char_length(_t), 'k', cast(null as string)))"
    pieces = _scan(marked, {"at": "0"}, {"at": "greatest(a.at, x.e)"}, f"if(x.s < a.at, '', concat({piece}, if(x.k is null, '', concat('[', upper(x.k), ']'))))", "string")
    built = f"array_join({pieces}, '')"
    text: Column = F.expr(f"case when row.text is null then null when size(_email) + size(_ip) + size(_card) + size(_phone) + size(_more) = 0 then row.text else {built} end")
    size = F.when(F.col("row.text").isNull(), F.col("row.n_chars")).otherwise(F.char_length(text)).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    new = {"text": text, "n_chars": size}
    return found.select(*((new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
