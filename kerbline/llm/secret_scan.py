"""Secret scans through a trigram inverted index, in DataFrame operations only.

From each rule's regular expression a Boolean trigram query is derived (after Cox, 2012): a disjunction of sets of trigrams
that a text must hold. Postings (trigram, document) are built for the trigrams that some query names and intersected by
counting; only documents that are left are verified with the expression itself. Rules without mandatory trigrams scan all
texts. Null and empty texts have no span; long texts are searched whole; repeated rows, and rows that share a doc_id, are each
searched for themselves (the index can only add candidates); null ids are searched as well; an empty table gives an empty table.
No expression repeats a group (Java does that by recursion) or looks at a run again from each of its places, so time and stack do not
grow with the square of a long run.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Rule:
    """`check`: (group, least length), matches that fail it are dropped after leftmost non-overlapping matching."""

    kind: str
    regex: str
    check: tuple[int, int] = (0, 0)
    base: bool = False


#: The base, then rules for well-known credential formats.
RULES = [
    Rule("assign", r"((?i)(?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", (2, 6), True),
    Rule("access", r"AKIA[A-Z0-9]+", (0, 20), True),
    Rule("hex", r"[0-9a-f]{24,}", (0, 24), True),
    Rule("sts", r"ASIA[A-Z0-9]{16}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("github_pat", r"github_pat_[A-Za-z0-9_]{22,82}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("slack_hook", r"hooks\.slack\.com/services/[A-Za-z0-9/]{20,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("sendgrid", r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"),
    Rule("twilio", r"SK[0-9a-f]{32}"),
    Rule("npm", r"npm_[A-Za-z0-9]{36}"),
    Rule("pypi", r"pypi-AgE[A-Za-z0-9_-]{20,}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]*"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("url_login", r"[a-z]{2,10}://[A-Za-z0-9._-]+:[^\x20\x09-\x0D/@:]{3,}@[A-Za-z0-9.-]+"),
    Rule("bearer", r"Bearer [A-Za-z0-9._~+/-]{20,}=*"),
]

#: More alternatives than this of one part of an expression count as unknown.
MOST = 64


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def mandatory(regex: str) -> frozenset[frozenset[str]] | None:
    """Alternatives, each a set of lower-case trigrams; a matching text holds all of at least one. None: nothing is mandatory.

    Concatenated parts known as small sets of strings are multiplied out; where a part is unknown the strings so far are closed
    and their trigrams kept.
    """
    import re._parser as parser

    def known(node) -> list[str] | None:
        """All strings of a part, lower-case, or None."""
        op, arg = str(node[0]), node[1]
        if op == "LITERAL":
            return [chr(arg).lower()]
        if op == "IN":
            got: set[str] = set()
            for k, v in arg:
                if str(k) == "LITERAL":
                    got.add(chr(v).lower())
                elif str(k) == "RANGE" and v[1] - v[0] < 8:
                    got |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
                else:
                    return None
            return sorted(got) if len(got) <= 8 else None
        if op == "SUBPATTERN":
            return all_of(arg[-1])
        if op == "BRANCH":
            parts = [all_of(x) for x in arg[1]]
            return None if any(p is None for p in parts) else sorted({s for p in parts for s in p})
        if op == "MAX_REPEAT" and arg[1] <= 3:
            inner = all_of(arg[2])
            return None if inner is None else sorted({"".join(x) for n in range(arg[0], arg[1] + 1) for x in product(inner, repeat=n)})[: MOST + 1]
        return None

    def all_of(nodes) -> list[str] | None:
        out = [""]
        for n in nodes:
            k = known(n)
            if k is None or len(out) * len(k) > MOST:
                return None
            out = [a + b for a in out for b in k]
        return out

    needs: list[frozenset[frozenset[str]]] = []

    def close(strings: list[str]) -> None:
        sets = frozenset(trigrams(s) for s in strings)
        if all(sets):
            needs.append(sets)

    def walk(nodes) -> None:
        out = [""]
        for n in nodes:
            k = known(n)
            if k is not None and len(out) * len(k) <= MOST:
                out = [a + b for a in out for b in k]
                continue
            close(out)
            out = [""]
            if str(n[0]) == "SUBPATTERN":
                walk(n[1][-1])
            elif str(n[0]) == "MAX_REPEAT" and n[1][0] >= 1:
                walk(n[1][2])
        close(out)

    walk(parser.parse(re.sub(r"\(\?i\)", "", regex)))
    if not needs:
        return None
    best: frozenset[frozenset[str]] = frozenset([frozenset()])
    for n in sorted(needs, key=len):
        if len(best) * len(n) <= MOST:
            best = frozenset(a | b for a in best for b in n)
    return frozenset(a for a in best if not any(b < a for b in best))


def candidates(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc, kinds): the documents that satisfy a rule's trigram query, with the rules they satisfy."""
    queries = [(r.kind, n, sorted(alt)) for r in rules if (q := mandatory(r.regex)) for n, alt in enumerate(sorted(q, key=sorted))]
    vocabulary = sorted({t for _, _, alt in queries for t in alt})
    low = docs.select("doc", F.lower("text").alias("low"))
    postings = low.select(
        "doc", F.explode(F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(vocabulary))))).alias("term")
    )
    number = {t: i for i, t in enumerate(vocabulary)}
    terms = [(kind, n, number[t], 1 << k, (1 << len(alt)) - 1) for kind, n, alt in queries for k, t in enumerate(alt)]
    wanted = docs.sparkSession.createDataFrame(terms, "kind string, alt int, term int, bit bigint, mask bigint")
    met = (
        postings.join(F.broadcast(wanted), "term")  # as many rows as the rules have trigrams
        .groupBy("doc", "kind", "alt")
        .agg(F.bit_or("bit").alias("bits"), F.first("mask").alias("mask"))
        .where("bits = mask")
    )
    return met.groupBy("doc").agg(F.collect_set("kind").alias("kinds"))


def spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end, kind>> of a rule's matches, by code points.

    Matches and what stands between them tile the text, so starts are running sums of lengths; they are taken in
    two steps of 64 to stay far from the square of the number of matches.
    """
    whole = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    gaps = F.split(text, rule.regex, -1)
    group, least = rule.check
    checked = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(group))
    data = F.struct(
        F.transform(whole, F.char_length).alias("m"),
        F.zip_with(gaps, whole, lambda g, m: F.char_length(g) + F.coalesce(F.char_length(m), F.lit(0))).alias("step"),
        F.transform(checked, F.char_length).alias("c"),
    )

    def found(d: Column) -> Column:
        add = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
        sums = F.transform(F.sequence(F.lit(0), F.floor(F.size(d["m"]) / 64)), lambda k: add(F.slice(d["step"], F.lit(1), k.cast("int") * 64)))
        with_sums = F.struct(d["m"].alias("m"), d["step"].alias("step"), d["c"].alias("c"), sums.alias("sums"))

        def place(e: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                block = F.floor(i / 64).cast("int")
                end = F.get(e["sums"], block) + add(F.slice(e["step"], block * 64 + 1, i - block * 64 + 1))
                return F.struct((end - m).alias("start"), end.alias("end"), F.lit(rule.kind).alias("kind"), (F.get(e["c"], i) >= least).alias("ok"))

            return F.transform(F.filter(F.transform(e["m"], one), lambda s: s["ok"]), lambda s: s.dropFields("ok"))

        return F.flatten(F.transform(F.array(with_sums), place))

    empty = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    return F.when(F.regexp_like(text, F.lit(rule.regex)), F.flatten(F.transform(F.array(data), found))).otherwise(empty)


def scan(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """row (all columns of `docs` but text), doc_id, text, and for each rule an array of spans found_<kind>."""
    rules = rules or RULES
    # Rows are known by a hash of id and text, so null ids are no large group; equal hashes only add candidates.
    rows = docs.select(F.struct(F.lit(0).alias("-"), *(f"`{c}`" for c in docs.columns if c != "text")).alias("row"), "doc_id", "text", F.xxhash64("doc_id", "text").alias("doc"))
    joined = rows.join(candidates(rows, rules), "doc", "left")
    empty = F.array().cast("array<struct<start:int,end:int,kind:string>>")

    def of(rule: Rule) -> Column:
        got = spans(F.coalesce("text", F.lit("")), rule)
        return got if mandatory(rule.regex) is None else F.when(F.array_contains("kinds", rule.kind), got).otherwise(empty)

    return joined.select("row", "doc_id", "text", *(of(r).alias(f"found_{r.kind}") for r in rules))


def listing(found: list[Column]) -> Column:
    """kind:start:end by start, then by the order of the rules, comma-joined."""
    keyed = [F.transform(f, lambda s, n=n: F.struct(s["start"].alias("start"), F.lit(n).alias("n"), s["end"].alias("end"), s["kind"].alias("kind"))) for n, f in enumerate(found)]
    return F.array_join(F.transform(F.array_sort(F.concat(*keyed)), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    return report(scan(common.table(spark, sf_dir, "documents").select("doc_id", "text")))


def report(found: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    rules = rules or RULES
    base = [r for r in rules if r.base]
    col = lambda r: F.col(f"found_{r.kind}")
    return found.select(
        "doc_id",
        *(F.size(col(r)).cast("long").alias(f"n_{r.kind}") for r in base),
        F.sha2(listing([col(r) for r in base]).cast("binary"), 256).alias("base_sha256"),
        listing([col(r) for r in rules]).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]", rules: list[Rule] | None = None) -> DataFrame:
    """`docs`, all rows and columns, with `mark` in place of every stretch of text that spans cover (n_chars follows the text)."""
    rules = rules or RULES
    pair = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))
    spots = F.array_sort(F.concat(*(F.transform(f"found_{r.kind}", pair) for r in rules)))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def cover(acc, s):
        fresh = s["start"] >= acc["at"]
        kept = F.substring(F.col("text"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], F.array(kept, F.lit(mark)))).otherwise(acc["out"]).alias("out"))

    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("text"), acc["at"] + 1, F.char_length("text")))
    clean = scan(docs, rules).select("row", "text", spots.alias("spots")).select(
        "row", "text", F.when(F.size("spots") > 0, F.aggregate("spots", zero, cover, rest)).alias("new")
    )
    kind = dict(docs.dtypes)
    out = []
    for c in docs.columns:
        old = F.col("text") if c == "text" else F.col("row").getField(c)
        put = {"text": F.col("new"), "n_chars": F.char_length("new").cast(kind.get("n_chars", "bigint"))}.get(c)
        out.append((old if put is None else F.when(F.col("new").isNotNull(), put).otherwise(old)).alias(c))
    return clean.select(*out)
