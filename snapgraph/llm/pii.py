"""Personal data by candidate gradient boosting.  DataFrame functions only.

Base spans come from the four fixed formats.  On top of them high-recall
generators propose wider, overlapping spans: number chains, spelled-out
addresses, and long runs of letters and digits that may be secrets.  A candidate
is described by its format and context.  No one labels candidates by hand, so
each generator has a weak label that its features do not show:

* number: whether it holds a valid base span (checksum, ranges and lengths are no features);
* written: addresses of the corpus spelled out in three ways, in their own
  context, are the positive ones, what the generator finds by itself and holds no address is not;
* secret: whether the words before it name a secret (a cue).

Candidates of the whole corpus are counted by description (the number of
descriptions is fixed by the code, at most ``MOST_CELLS``), boosted trees are fit
on these counts, and for each generator the lowest score at which the held-out
fifth of the documents still shows ``PRECISION`` is its threshold; a secret with a
cue needs only ``CUE_PRECISION``.  The trees are then one Column expression.
A candidate above the threshold that holds no base span is added; base spans stay.

The text is read once: matches and the pieces between them are written, and
places are running sums of their lengths, so nothing is quadratic in a text's
matches.  Quantifiers that could run over one another are possessive.

Null text: empty.  Null doc_id: kept.  Empty table: no rows.  Repeated rows: one
row each.  Ties in a threshold count as above it.  No label or one class only:
nothing is added.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from snapgraph.llm.common import written

PRECISION, CUE_PRECISION, ROUNDS, RATE = 0.9, 0.3, 30, 0.3
#: Base formats: fixed values.  Written with look-behinds and possessive quantifiers, they match what the plain forms match.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Generators.
NUMBER = r"(?<![0-9A-Za-z])[+(]?[0-9](?:[\x20().\-/]{0,2}+[0-9]){6,}+(?![0-9A-Za-z])"
DOT = r"(?:\x20?[\[(]dot[\])]\x20?|\x20dot\x20)"
WRITTEN = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+(?:\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{2,63}+(?:(?:" + DOT + r"|\.)[A-Za-z0-9-]{2,24}+){1,4}+"
    r"|@[A-Za-z0-9-]{2,63}+(?:" + DOT + r"[A-Za-z0-9-]{2,24}+){1,4}+|\x20at\x20[A-Za-z0-9-]{2,63}+(?:" + DOT + r"[A-Za-z0-9-]{2,24}+){1,4}+|@[A-Za-z0-9-]{2,63}+(?:\.[A-Za-z0-9-]{2,24}+){1,4}+)"
)
#: A run that may be a secret: 20 characters or more, with a letter and a digit among them.
SECRET = r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/-]*[0-9])(?=[0-9_+/-]*[A-Za-z])[A-Za-z0-9_+/-]{20,}+={0,2}+(?![A-Za-z0-9_+/=@-])"
CUE = r"(?i)(?:token|secret|key|password|passwd|pwd|auth|bearer|credentials?)[\"']?\s{0,2}[:=]?\s{0,2}[\"']?$"
KINDS = ("email", "ip", "card", "phone", "number", "written", "secret")
PATTERNS = (EMAIL, IP, CARD, PHONE, NUMBER, WRITTEN, SECRET)
SECRET_KIND = KINDS.index("secret") - 4
#: Ways in which an address is spelled out: what stands for the at sign, what for each dot behind it.
STYLES = ((" at ", " dot "), (" [at] ", " [dot] "), (" (at) ", " (dot) "))
VALID_IP = r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])\.){3}0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
CONTEXT = r"(?i)(?:phone|tel|call|mobile|fax|mail|contact|card|visa|address|iban|ssn|passport|user)[^\n]{0,14}$"


def gates(text: Column) -> list[Column]:
    """Cheap conditions without which a pattern cannot give a valid span."""
    digit = text.rlike("[0-9]")
    at = F.contains(text, F.lit("@"))
    dot = text.rlike(r"[\[( ]dot[\]) ]")
    return [at, digit & text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), digit & text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), F.contains(text, F.lit("+")) & text.rlike(r"\+[0-9]"), digit & text.rlike(r"[0-9](?:[\x20().\-/]{0,2}+[0-9]){6}"), at | dot, digit & text.rlike("[A-Za-z0-9_+/-]{20}")]


def found(docs: DataFrame) -> DataFrame:
    """row, doc_id, and for each pattern its matches m_k and the pieces around them p_k (length, last 24 and first 1 characters)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"))
    t = F.col("t")
    columns = []
    for k, (pattern, gate) in enumerate(zip(PATTERNS, gates(t))):
        pieces = F.transform(F.split(t, pattern, -1), lambda p: F.struct(F.char_length(p).alias("n"), F.right(p, F.lit(24)).alias("l"), F.left(p, F.lit(1)).alias("r")))
        columns += [F.when(gate, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).alias(f"m_{k}"), F.when(gate, pieces).alias(f"p_{k}")]
    return rows.select("row", "doc_id", *columns)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the checksum: every second digit from the right is doubled."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*(F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def spans(matches: DataFrame) -> DataFrame:
    """One row per match: row, doc_id, k, m, start, end and the text around it.  Places are running sums within a document."""
    def numbered(k: int) -> Column:
        m, p = F.col(f"m_{k}"), F.col(f"p_{k}")
        zipped = F.arrays_zip(m.alias("m"), F.slice(p, F.lit(1), F.size(m)).alias("a"), F.slice(p, F.lit(2), F.size(m)).alias("b"))
        one = lambda z, i: F.struct(F.lit(k).alias("k"), i.alias("i"), z["m"].alias("m"), z["a"]["n"].alias("n"), z["a"]["l"].alias("l"), z["b"]["r"].alias("r"))
        return F.when(F.size(m) > 0, F.transform(zipped, one)).otherwise(F.array())

    each = [numbered(k) for k in range(len(KINDS))]
    flat = matches.select("row", "doc_id", F.explode(F.concat(*each)).alias("s")).select("row", "doc_id", "s.*")
    so_far = W.partitionBy("row", "k").orderBy("i")
    end = F.sum(F.col("n") + F.char_length("m")).over(so_far.rowsBetween(W.unboundedPreceding, W.currentRow))
    return flat.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - F.char_length("m"))


def checked(rows: DataFrame) -> DataFrame:
    """Adds d (the digits), and ok: a valid base span, or for a candidate that its text is or holds one."""
    digits = F.regexp_replace("m", "[^0-9]", "")
    rows = rows.withColumn("d", digits)
    n, k, m = F.char_length("d"), F.col("k"), F.col("m")
    card = (n >= 13) & (n <= 19) & F.when((n >= 13) & (n <= 19), luhn(F.col("d"))).otherwise(False)
    phone = (n >= 9) & (n <= 15)
    number = m.rlike(VALID_IP) | (m.rlike(f"^{CARD}$") & card) | (m.rlike(f"^{PHONE}$") & phone)
    ok = F.when(k == 0, True).when(k == 1, m.rlike(VALID_IP)).when(k == 2, card).when(k == 3, phone).when(k == 4, number).when(k == 5, m.rlike(EMAIL)).otherwise(False)
    return rows.withColumn("ok", ok)


def spelled_out(rows: DataFrame) -> DataFrame:
    """The rows, and every address once more in each style as a made-up candidate of its own context."""
    m = F.col("m")
    name, host = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    real = F.struct(F.col("k").alias("k"), m.alias("m"), F.lit(False).alias("made"))
    made = [F.struct(F.lit(5).alias("k"), F.concat(name, F.lit(at), F.replace(host, F.lit("."), F.lit(dot))).alias("m"), F.lit(True).alias("made")) for at, dot in STYLES]
    each = F.explode(F.when(F.col("k") == 0, F.array(real, *made)).otherwise(F.array(real)))
    return rows.withColumn("v", each).select(*(c for c in rows.columns if c not in ("k", "m")), "v.*")


FEATURES = ("f_kind", "f_digits", "f_groups", "f_mark", "f_lead", "f_left", "f_right", "f_word")
#: The most descriptions there can be: the product of the features' values.
MOST_CELLS = 3 * 9 * 5 * 5 * 3 * 4 * 4 * 2


def described(rows: DataFrame) -> DataFrame:
    """Adds the features of a candidate, small whole numbers, and label, the weak label of its generator."""
    m, n, k = F.col("m"), F.char_length("d"), F.col("k")
    groups = F.size(F.split("m", "[^0-9]+")) - F.when(m.rlike("^[^0-9]"), 1).otherwise(0) - F.when(m.rlike("[^0-9]$"), 1).otherwise(0)
    digits = F.when(n == 0, 0).when(n < 7, 1).when(n < 9, 2).when(n == 9, 3).when(n < 13, 4).when(n < 16, 5).when(n == 16, 6).when(n < 20, 7).otherwise(8)
    mark = F.when(m.rlike(r"[().]"), F.when(m.rlike(r"[\x20/-]"), 4).otherwise(1)).when(m.rlike(r"\x20"), 2).when(m.rlike("[/-]"), 3).otherwise(0)
    lead = F.when(m.startswith("+"), 1).when(m.startswith("("), 2).otherwise(0)
    # Addresses: labels of the host, how at and dot are written, length of the last label.
    labels = F.size(F.split("m", DOT + r"|\.")) - 1
    spelling = F.when(m.rlike(r"[\[(]at"), 1).when(m.rlike(r"\x20at\x20"), 2).when(m.rlike(DOT), 3).otherwise(0)
    tail = F.char_length(F.regexp_extract("m", "([A-Za-z0-9]*)$", 1))
    # Secrets: length, alphabet, share of digits.
    size = F.char_length("m")
    long = F.when(size < 24, 0).when(size < 32, 1).when(size == 32, 2).when(size < 40, 3).when(size == 40, 4).when(size < 64, 5).when(size == 64, 6).when(size < 100, 7).otherwise(8)
    alphabet = F.when(m.rlike("^[0-9a-f]+$"), 0).when(m.rlike("^[0-9A-F]+$"), 1).when(m.rlike("^[0-9A-Za-z]+$"), 2).when(m.rlike("^[0-9A-Za-z_-]+$"), 3).otherwise(4)
    share = F.least(F.floor(n * 5 / size), F.lit(4))
    left, right = F.right(F.col("l"), F.lit(1)), F.col("r")
    around = lambda c: F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike(r"[\"'=:(\[<]"), 2).otherwise(3)
    pick = lambda number, written, secret: F.when(k == 6, secret).when(k == 5, written).otherwise(number).cast("int")
    bound = lambda c, most: F.least(F.greatest(c, F.lit(0)), F.lit(most))
    return rows.select(
        "*",
        (k - 4).alias("f_kind"),
        pick(digits, digits, long).alias("f_digits"),
        pick(bound(groups, 4), bound(labels, 4), alphabet).alias("f_groups"),
        pick(mark, spelling, share).alias("f_mark"),
        pick(lead, F.when(tail < 2, 0).when(tail < 4, 1).otherwise(2), F.when(m.endswith("="), 1).otherwise(0)).alias("f_lead"),
        around(left).alias("f_left"),
        around(right).alias("f_right"),
        F.when((k != 6) & F.col("l").rlike(CONTEXT), 1).otherwise(0).alias("f_word"),
        F.when(k == 6, F.col("l").rlike(CUE)).when(k == 5, F.col("ok") | F.col("made")).otherwise(F.col("ok")).alias("label"),
    )


def fit_trees(cells: list[tuple], rounds: int = ROUNDS, rate: float = RATE) -> tuple[float, list]:
    """Boosted depth-2 trees for log-odds over counted descriptions [(features, positive, negative)]; a tree is (test, (test, leaf, leaf), (test, leaf, leaf))."""
    good, bad = sum(c[1] for c in cells), sum(c[2] for c in cells)
    if not good or not bad:
        return 0.0, []
    base = math.log(good / bad)
    x = np.array([c[0] for c in cells])
    pos, neg = np.array([c[1] for c in cells], float), np.array([c[2] for c in cells], float)
    score = np.full(len(cells), base)
    tests = sorted({(f, int(v)) for f in range(x.shape[1]) for v in np.unique(x[:, f])})
    trees = []

    def side(rows: np.ndarray, grad: np.ndarray, hess: np.ndarray):
        """Best test of the rows and its two leaves."""
        total_g, total_h = grad[rows].sum(), hess[rows].sum()
        best = (total_g**2 / (total_h + 1), None, total_g / (total_h + 1), total_g / (total_h + 1))
        sums = {f: (np.bincount(x[rows, f], grad[rows]), np.bincount(x[rows, f], hess[rows])) for f in range(x.shape[1])}
        for f, v in tests:
            if v >= len(sums[f][0]):
                continue
            g, h = sums[f][0][v], sums[f][1][v]
            gain = g**2 / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1)
            if gain > best[0] + 1e-9:
                best = (gain, (f, v), g / (h + 1), (total_g - g) / (total_h - h + 1))
        return best

    every = np.arange(len(cells))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        grad, hess = pos * (1 - p) - neg * p, (pos + neg) * p * (1 - p)
        _, test, _, _ = side(every, grad, hess)
        if test is None:
            break
        inside = x[:, test[0]] == test[1]
        yes, no = (side(np.flatnonzero(half), grad, hess)[1:] for half in (inside, ~inside))
        clip = lambda v: float(max(-4.0, min(4.0, v)) * rate)
        tree = (test, (yes[0], clip(yes[1]), clip(yes[2])), (no[0], clip(no[1]), clip(no[2])))
        trees.append(tree)
        score = np.clip(score + np.array([value(tree, c[0]) for c in cells]), -30.0, 30.0)
    return base, trees


def value(tree, features: tuple) -> float:
    test, yes, no = tree
    inner = yes if features[test[0]] == test[1] else no
    return inner[1] if inner[0] is not None and features[inner[0][0]] == inner[0][1] else inner[2]


def expression(base: float, trees: list) -> Column:
    """The boosted score as one Column."""

    def leaf(inner) -> Column:
        test, yes, no = inner
        return F.lit(no) if test is None else F.when(F.col(FEATURES[test[0]]) == test[1], F.lit(yes)).otherwise(F.lit(no))

    total = F.lit(base)
    for test, yes, no in trees:
        total = total + F.when(F.col(FEATURES[test[0]]) == test[1], leaf(yes)).otherwise(leaf(no))
    return total


def thresholds(cells: list[tuple], base: float, trees: list, precision: float = PRECISION) -> dict[int, float]:
    """For each generator the lowest score with this precision on the counts given."""
    out = {}
    for kind in range(len(KINDS) - 4):
        scored = sorted(((base + sum(value(t, c[0]) for t in trees), c[1], c[2]) for c in cells if c[0][0] == kind), reverse=True)
        good = bad = 0
        for s, a, b in scored:
            good, bad = good + a, bad + b
            if good and good >= precision * (good + bad):
                out[kind] = s - 1e-9
    return out


def detected(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_found (base and added spans)."""
    matches, _ = written(found(docs), "matches")
    anything = F.greatest(*(F.coalesce(F.size(f"m_{k}"), F.lit(0)) for k in range(len(KINDS)))) > 0
    rows, _ = written(described(checked(spelled_out(spans(matches.where(anything))))).select("row", "doc_id", "k", "start", "end", "ok", "made", "label", *FEATURES), "spans")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    # At most MOST_CELLS rows for each fold, whatever the corpus.
    counts = rows.where("k >= 4").groupBy(fold.alias("held"), *FEATURES).agg(F.count_if("label").alias("good"), F.count_if(~F.col("label")).alias("bad")).collect()
    cells = {held: [(tuple(r[f] for f in FEATURES), r["good"], r["bad"]) for r in counts if r["held"] == held] for held in (False, True)}
    base, trees = fit_trees(sorted(cells[False]))
    score = expression(base, trees)
    cut, cut_cue = (thresholds(cells[True], base, trees, p) if trees else {} for p in (PRECISION, CUE_PRECISION))
    above = F.lit(False)
    for kind, least in cut.items():
        above = above | ((F.col("f_kind") == kind) & (score >= least))
    if SECRET_KIND in cut_cue:
        above = above | ((F.col("f_kind") == SECRET_KIND) & F.col("label") & (score >= cut_cue[SECRET_KIND]))
    kept = rows.where(~F.col("made")).withColumn("base", (F.col("k") < 4) & F.col("ok")).withColumn("added", (F.col("k") >= 4) & ~F.col("ok") & above)
    span = F.struct("k", "start", "end")
    names = F.array(*(F.lit(n) for n in KINDS))
    text = lambda c: F.concat_ws(",", F.transform(F.sort_array(c), lambda s: F.concat(F.element_at(names, s["k"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))))
    some = kept.groupBy("row", "doc_id").agg(
        *(F.count_if(F.col("base") & (F.col("k") == k)).alias(f"n_{KINDS[k]}") for k in range(4)),
        F.sha2(text(F.collect_list(F.when(F.col("base"), span))), 256).alias("base_sha256"),
        text(F.collect_list(F.when(F.col("base") | F.col("added"), span))).alias("spans"),
        F.count_if("added").alias("n_added"),
        F.count_if(F.col("base") | F.col("added")).alias("n_found"),
    )
    zero = F.lit(0).cast("long")
    none = matches.where(~anything).select("doc_id", *(zero.alias(f"n_{KINDS[k]}") for k in range(4)), F.sha2(F.lit(""), 256).alias("base_sha256"), F.lit("").alias("spans"), zero.alias("n_added"), zero.alias("n_found"))
    return some.drop("row").unionByName(none)
