"""Quality rules by weak supervision: rules vote or abstain, EM weighs them.

Everything is a DataFrame expression.  The texts are read once; what the rules
say about a document is one small number, and the model sees only how often each
of at most 3^8 vote patterns occurs.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import let, prefix_for, stored, word_array

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"
BAD, NONE, GOOD = 0, 1, 2
ROUNDS = 40
SIGNALS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside a window of words that occurs twice or more in the text."""
    def windows(h):
        return F.when(F.size(h) >= window, F.transform(
            F.sequence(F.lit(0), F.size(h) - window),
            lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))).otherwise(
                F.array().cast("array<bigint>"))

    def covered(w):
        order = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def starts(s):
            hit = F.filter(s, lambda e, j: (e["x"] == F.get(s, j - 1)["x"]) | (e["x"] == F.get(s, j + 1)["x"]))
            return F.sort_array(F.transform(hit, lambda e: e["i"]))

        def total(p):
            return F.aggregate(
                F.transform(p, lambda x, j: F.least(F.lit(window), F.coalesce(F.get(p, j + 1) - x, F.lit(window)))),
                F.lit(0), lambda a, x: a + x)
        return let(let(order, starts), total)

    def count(w):
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w))
    return let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), count)


def _votes(q: dict[str, Column]) -> list[Column]:
    """One vote per rule; a rule abstains where it has nothing to go by."""
    def rule(bad, good):
        return F.when(bad, BAD).when(good, GOOD).otherwise(NONE)
    n, many = q["n_words"], q["n_words"] >= 20
    return [
        rule(q["n_symbols"] * 10 > n, many & (q["n_symbols"] * 50 <= n)),
        rule(many & (q["distinct"] * 100 < 35 * n), many & (q["distinct"] * 100 >= 50 * n)),
        rule((q["lines"] >= 4) & (q["n_dup_lines"] * 100 > 40 * q["lines"]),
             (q["lines"] >= 4) & (q["n_dup_lines"] * 100 <= 10 * q["lines"])),
        rule(many & (q["n_repeat_words"] * 100 > 30 * n), many & (q["n_repeat_words"] * 100 <= 5 * n)),
        rule(many & ((q["word_chars"] < 3 * n) | (q["word_chars"] > 10 * n)),
             many & (q["word_chars"] * 2 >= 7 * n) & (q["word_chars"] <= 8 * n)),
        rule(many & (q["upper"] * 10 > 3 * q["word_chars"]), many & (q["upper"] * 10 <= q["word_chars"])),
        rule(many & (q["stops"] * 10 > 6 * n), many & (q["stops"] * 10 <= 4 * n) & (q["stops"] * 50 >= n)),
        rule(n < 20, n >= 50),
    ]


N_RULES = 8


def signals(docs: DataFrame, text: str, prefix: str) -> DataFrame:
    """``docs`` with the columns ``<prefix><signal>``, ``<prefix>failed`` and ``<prefix>pattern``."""
    c = {k: F.col(prefix + k) for k in [*SIGNALS, "words", "lines_all", "distinct", "lines", "upper", "stops"]}
    body = F.coalesce(F.col(text), F.lit(""))
    df = docs.select("*", word_array(F.col(text)).alias(prefix + "words"), F.filter(
        F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias(prefix + "lines_all"))
    df = df.select(
        *docs.columns,
        F.size(c["words"]).cast("long").alias(prefix + "n_words"),
        F.char_length(F.array_join(c["words"], "")).cast("long").alias(prefix + "word_chars"),
        F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias(prefix + "n_symbols"),
        (F.size(c["lines_all"]) - F.size(F.array_distinct(c["lines_all"]))).cast("long").alias(prefix + "n_dup_lines"),
        repeated_words(c["words"]).cast("long").alias(prefix + "n_repeat_words"),
        F.size(F.array_distinct(c["words"])).alias(prefix + "distinct"),
        F.size(c["lines_all"]).alias(prefix + "lines"),
        F.regexp_count(body, F.lit(r"\p{Lu}")).alias(prefix + "upper"),
        F.regexp_count(body, F.lit("[.!?]")).alias(prefix + "stops"))
    code = F.lit(0)
    for j, vote in enumerate(_votes(c)):
        code = code + vote * (3 ** j)
    failed = (c["n_words"] < 20) | (c["n_repeat_words"] * 100 > c["n_words"] * 30)
    return df.select(*docs.columns, *[prefix + s for s in SIGNALS],
                     failed.alias(prefix + "failed"), code.alias(prefix + "pattern"))


def label_model(patterns: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``(pattern, p_good)`` from ``(pattern, n)``: EM over hidden kinds of document.

    Kind 0 is clean, kind j + 1 is the junk that rule j looks for, since junk of
    one kind says nothing about the rules for the others.  A kind gives each rule
    the chance that its vote is bad when it votes; given the kind, rules are
    independent, and an abstention tells nothing.  At the start a document
    belongs to the kinds of its bad votes, or is clean.  All rounds run inside
    one expression over the array of patterns, which has at most 3^8 entries
    however large the corpus.
    """
    rules, kinds = F.sequence(F.lit(0), F.lit(N_RULES - 1)), F.sequence(F.lit(0), F.lit(N_RULES))
    zero = F.lit(0.0)

    def total(ps, weight):
        return F.aggregate(ps, zero, lambda s, p: s + weight(p))

    def learn(ps, every):
        def kind(c):
            def chance(j):
                bad = total(ps, lambda p: F.when(F.get(p["votes"], j) == BAD, p["n"] * F.get(p["w"], c)).otherwise(zero))
                voted = total(ps, lambda p: F.when(F.get(p["votes"], j) != NONE, p["n"] * F.get(p["w"], c)).otherwise(zero))
                return (bad + 0.01) / (voted + 0.02)
            return F.struct(F.log((total(ps, lambda p: p["n"] * F.get(p["w"], c)) + 0.01) / (every + 0.1)).alias("prior"),
                            F.transform(rules, chance).alias("bad"))
        return F.transform(kinds, kind)

    def rate(model, ps):
        def odds(m, p):
            return F.aggregate(rules, m["prior"], lambda s, j: s + F.when(
                F.get(p["votes"], j) == BAD, F.log(F.get(m["bad"], j))).when(
                    F.get(p["votes"], j) == GOOD, F.log(1 - F.get(m["bad"], j))).otherwise(zero))

        def normal(o):
            e = F.transform(o, lambda x: F.exp(x - F.array_max(o)))
            return let(e, lambda y: F.transform(y, lambda x: x / F.aggregate(y, zero, lambda s, z: s + z)))
        return F.transform(ps, lambda p: F.struct(
            p["pattern"].alias("pattern"), p["n"].alias("n"), p["votes"].alias("votes"),
            let(F.transform(model, lambda m: odds(m, p)), normal).alias("w")))

    def start(p):
        n_bad = F.size(F.filter(p["votes"], lambda v: v == BAD))
        return F.concat(F.array(F.when(n_bad > 0, 0.1).otherwise(0.9)), F.transform(
            p["votes"], lambda v: F.when(v == BAD, 0.9 / n_bad).when(n_bad > 0, 0.0).otherwise(0.1 / N_RULES)))

    ps = F.transform(F.sort_array(F.collect_list(F.struct("pattern", "n"))), lambda p: F.struct(
        p["pattern"].alias("pattern"), p["n"].cast("double").alias("n"),
        F.transform(rules, lambda j: F.floor(p["pattern"] / F.pow(F.lit(3.0), j)).cast("int") % 3).alias("votes")))
    one = patterns.agg(ps.alias("ps"), F.sum("n").cast("double").alias("every"))
    first = F.transform("ps", lambda p: F.struct(
        p["pattern"].alias("pattern"), p["n"].alias("n"), p["votes"].alias("votes"), start(p).alias("w")))
    rated = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first,
                        lambda state, _: let(learn(state, F.col("every")), lambda model: rate(model, state)))
    return one.select(F.explode(rated).alias("p")).select("p.pattern", F.col("p.w")[0].alias("p_good"))


def judge(docs: DataFrame, text: str = "text", columns: list[str] | None = None) -> tuple[DataFrame, str]:
    """``docs`` (or the named columns) with signals, posterior and verdict; and the prefix of these.

    Added: ``<prefix>`` + the five signals, ``failed``, ``p_good``, ``kept``.  A
    document is kept when no base check failed and clean is the likelier class.
    A null or empty text has no words and fails.  Repeated rows are judged one
    by one, alike.  An empty table gives an empty table.  Other columns pass
    through whatever their names.
    """
    prefix = prefix_for(docs)
    seen = signals(docs, text, prefix)
    if columns is not None:
        seen = seen.select(*columns, *[c for c in seen.columns if c.startswith(prefix)])
    seen = stored(seen, "signals")
    code = prefix + "pattern"
    model = label_model(seen.groupBy(F.col(code).alias("pattern")).agg(F.count("*").alias("n")))
    model = model.select(F.col("pattern").alias(code), F.col("p_good").alias(prefix + "p_good"))
    # at most 3^8 rows
    return seen.join(F.broadcast(model), code, "left").withColumn(
        prefix + "kept", ~F.col(prefix + "failed") & (F.col(prefix + "p_good") >= 0.5)), prefix


def quality_table(docs: DataFrame) -> DataFrame:
    """One row per document: signals, base verdict and verdict."""
    df, p = judge(docs, columns=["doc_id"])
    return df.select("doc_id", *[F.col(p + s).alias(s) for s in SIGNALS],
                     F.col(p + "failed").alias("base_failed"), F.col(p + "kept").alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns."""
    df, p = judge(docs)
    return df.where(F.col(p + "kept")).select(*docs.columns)
