"""Rule-based extraction of a typed property graph, one projection per document.

A document meets its lexicon where it is read, as literals of the plan or as one automaton: no join
and no shuffle before nodes are deduplicated.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigraph import schemas
from filigraph.functions.models import model_answer
from filigraph.functions.text import let, once, slug, strip, words
from filigraph.operators import lexicon_table
from filigraph.operators.lexicon import Lexicon
from filigraph.operators.lexicon_table import LexiconTable

_NODE_COLUMNS = [x.split()[0] for x in schemas.NODE.split(", ")]


def mission(text: Column, lexicon: Lexicon) -> Column:
    """The first rule's hit in lower-case text, else the first sentence of more than 40 characters; 500 at most."""
    rules = lambda lower: [F.nullif(F.regexp_extract(lower, f"(?U){p}", 1), F.lit("")) for p in lexicon.missions]
    said = let(F.lower(text), lambda lower: F.coalesce(*[F.substring(strip(r), 1, 500) for r in rules(lower)]))
    sentence = F.get(F.filter(F.transform(F.split(text, "[.]"), strip), lambda s: F.length(s) > 40), F.lit(0))
    return F.coalesce(said, F.substring(sentence, 1, 500))


def sentence_at(text: Column, at: Column) -> Column:
    """The sentence around a place (from 1); null at 0. Without a stop 201 characters follow."""
    left = F.substring_index(F.substring(text, F.lit(1), at - 1), ".", -1)
    tail = let(F.substring(text, at, F.length(text)), lambda right: F.when(F.contains(right, F.lit(".")), F.concat(F.substring_index(right, ".", 1), F.lit("."))).otherwise(F.substring(right, 1, 201)))
    return F.when(at > 0, strip(F.concat(left, tail)))


def sentence_around(text: Column, lower: Column, keyword: Column) -> Column:
    """The sentence around a keyword's first place; null where it is absent."""
    return let(F.position(keyword, lower), lambda at: sentence_at(text, at))


def objectives(text: Column, lexicon: Lexicon) -> Column:
    """array<struct<text, objective_type>>: for each type the first keyword with a sentence of more than 20 characters."""

    def of(kind: str, keywords: tuple[str, ...], lower: Column) -> Column:
        long_one = lambda k: let(sentence_around(text, lower, F.lit(k)), lambda s: F.when(F.length(s) > 20, F.substring(s, 1, 500)))
        return F.struct(F.coalesce(*[long_one(k) for k in keywords]).alias("text"), F.lit(kind).alias("objective_type"))

    found = let(F.lower(text), lambda lower: F.array(*[of(kind, keywords, lower) for kind, keywords in lexicon.objectives.items()]))
    return F.slice(F.filter(found, lambda o: o["text"].isNotNull()), 1, lexicon.most_objectives)


def capabilities(text: Column, lexicon: Lexicon) -> Column:
    found = let(F.lower(text), lambda lower: F.filter(F.array(*[F.lit(k) for k in lexicon.capabilities]), lambda k: F.contains(lower, k)))
    return F.transform(F.slice(found, 1, lexicon.most_capabilities), lambda k: F.struct(k.alias("name")))


def initiatives(text: Column, lexicon: Lexicon) -> Column:
    hits = F.concat(*[F.regexp_extract_all(text, F.lit(f"(?U){p}"), F.lit(1)) for p in lexicon.initiatives])
    names = F.filter(F.transform(hits, strip), lambda n: (F.length(n) > 10) & (F.length(n) < 80))
    return F.transform(F.slice(names, 1, lexicon.most_initiatives), lambda n: F.struct(n.alias("name"), F.lit("active").alias("status")))


def risks(text: Column, lexicon: Lexicon) -> Column:
    """array<struct<name, risk_category>>: the first keyword of each category, the first categories."""
    first = lambda keywords, lower: F.coalesce(*[F.when(F.contains(lower, F.lit(k)), F.lit(k)) for k in keywords])
    found = let(F.lower(text), lambda lower: F.array(*[F.struct(first(keywords, lower).alias("name"), F.lit(kind).alias("risk_category")) for kind, keywords in lexicon.risks.items()]))
    return F.slice(F.filter(found, lambda r: r["name"].isNotNull()), 1, lexicon.most_risks)


def extract(sections: DataFrame, lexicon: Lexicon | LexiconTable | None = None, shortest: int = 100) -> DataFrame:
    """The record of each ``ticker, cik, text`` row; texts under ``shortest`` characters have none.

    ``cik`` is optional. A ``record`` column of the record's type, as a language model gives it, goes before the rules. Keywords of a
    :class:`Lexicon` are literals of the plan; those of a :class:`LexiconTable`, which may be very many, are found by one automaton.
    """
    lexicon = lexicon or Lexicon()
    text = F.col("text")
    if isinstance(lexicon, LexiconTable):
        sections = sections.where(F.length("text") >= shortest).withColumn("__hits", lexicon_table.finder(lexicon.keywords)(F.lower("text")))
        hits = F.col("__hits")
        found = (lexicon_table.objectives(hits, text, sentence_at, lexicon), lexicon_table.capabilities(hits, lexicon), lexicon_table.risks(hits, lexicon))
    else:
        found = (objectives(text, lexicon), capabilities(text, lexicon), risks(text, lexicon))
    cik = F.col("cik") if "cik" in sections.columns else F.lit(None).cast("string")
    said = mission(text, lexicon)
    fields = {
        "Mission": F.when(said.isNotNull(), F.struct(said.alias("text"))),
        "StrategicObjective": found[0],
        "Capability": found[1],
        "Initiative": initiatives(text, lexicon),
        "RiskTheme": found[2],
    }
    if "record" in sections.columns:
        fields = {k: F.when(F.col("record").isNotNull(), F.col(f"record.{k}")).otherwise(v) for k, v in fields.items()}
    rows = sections.where(F.length("text") >= shortest)
    company = F.struct(F.col("ticker").cast("string").alias("ticker"), cik.alias("cik")).alias("Company")
    # The explode of one row keeps the optimiser from copying the rules into every later use of their results.
    rules = once(F.struct(company, *[v.alias(k) for k, v in fields.items()])).alias("r")
    return with_edges(rows.select(rules).select("r.*"))


def with_edges(records: DataFrame) -> DataFrame:
    """Adds the triples in words: objectives by their first 50 characters, links to the first objective and capability."""
    triple = lambda a, rel, b: F.array(a if isinstance(a, Column) else F.lit(a), F.lit(rel), b)
    none = F.array().cast("array<array<string>>")
    goal, skill = F.get("StrategicObjective", F.lit(0)), F.get("Capability", F.lit(0))
    flat = lambda name, f: F.flatten(F.transform(F.coalesce(F.col(name), F.array()), f))
    skills = lambda c: F.filter(F.array(triple("Company", "buildsCapability", c["name"]), F.when(goal.isNotNull(), triple("Capability", "supportsObjective", F.substring(goal["text"], 1, 50)))), lambda t: t.isNotNull())
    moves = lambda i: F.filter(F.array(triple("Company", "pursues", i["name"]), F.when(skill.isNotNull(), triple("Initiative", "initiativeEnables", skill["name"]))), lambda t: t.isNotNull())
    edges = F.concat(
        F.when(F.col("Mission").isNotNull(), F.array(triple("Company", "hasMission", F.lit("Mission")))).otherwise(none),
        F.transform(F.coalesce("StrategicObjective", F.array()), lambda o: triple("Company", "statesObjective", F.substring(o["text"], 1, 50))),
        flat("Capability", skills),
        flat("Initiative", moves),
        F.transform(F.coalesce("RiskTheme", F.array()), lambda r: triple("Company", "exposedTo", r["name"])),
    )
    return records.withColumn("Edges", edges)


def parse_record(answer: Column) -> Column:
    """The record in a language model's answer: the text from the first to the last brace; null if it is none."""
    return F.from_json(F.nullif(F.regexp_extract(answer, r"(?s)\{.*\}", 0), F.lit("")), schemas.RECORD, {"mode": "PERMISSIVE"})


def prompt_words(text: Column, most: int = 3000) -> Column:
    """What a language model gets of a text: its first words."""
    return F.array_join(F.slice(words(text), 1, most), " ")


class Extractor(Protocol):
    """Adds ``record`` (null where it has none) to a table with ``text``."""

    def extract(self, sections: DataFrame) -> DataFrame: ...


class ModelExtractor:
    """Any language model: ``load`` runs once a worker and gives a function from a prompt to an answer. What fails or holds no record gives null, and the rules stand."""

    def __init__(self, load: Callable[[], Callable[[str], str]], instruction: str = "Return the company's record as one JSON object.", most_words: int = 3000):
        self.load, self.instruction, self.most_words = load, instruction, most_words

    def extract(self, sections: DataFrame) -> DataFrame:
        asked = F.concat(F.lit(self.instruction + "\n\n"), prompt_words(F.coalesce("text", F.lit("")), self.most_words))
        return sections.withColumn("__answer", model_answer(self.load)(asked)).withColumn("record", parse_record(F.col("__answer"))).drop("__answer")


def _id(label: str, name: Column) -> Column:
    return F.concat_ws(":", F.lit(label), F.col("Company.ticker"), slug(name))


#: Label, what names it, default name, edge from the company, the column that only this kind fills.
_PARTS = (
    ("StrategicObjective", "text", "objective", "statesObjective", "objective_type"),
    ("Capability", "name", "capability", "buildsCapability", None),
    ("Initiative", "name", "initiative", "pursues", "status"),
    ("RiskTheme", "name", "risk", "exposedTo", "risk_category"),
)


def _listed(label: str, make) -> Column:
    return F.transform(F.coalesce(F.col(label), F.array()), make)


def _present(table: str, *parts: Column) -> Column:
    """One array of all structs that are not null."""
    return F.filter(F.concat(*parts).cast(f"array<struct<{', '.join(':'.join(x.split()) for x in table.split(', '))}>>"), lambda x: x.isNotNull())


def nodes(records: DataFrame, companies: DataFrame | None = None) -> DataFrame:
    """The node table of records, by one pass over them. ``companies`` gives names by ticker; ``ord`` counts kinds and places of a document."""
    none = F.lit(None).cast("string")

    def node(**values: Column) -> Column:
        return F.struct(*[values.get(c, none).alias(c) for c in _NODE_COLUMNS])

    own = node(id=F.concat_ws(":", F.lit("Company"), F.col("Company.ticker")), label=F.lit("Company"), ticker=F.col("Company.ticker"), cik=F.col("Company.cik"), ord=F.lit(0).cast("bigint"))
    goal = node(id=F.concat_ws(":", F.lit("Mission"), F.col("Company.ticker"), F.lit("mission")), label=F.lit("Mission"), text=F.col("Mission.text"), ord=F.lit(1).cast("bigint"))

    def listed(k: int) -> Column:
        label, by, default, _, extra = _PARTS[k]
        return _listed(label, lambda x, i: node(**({"id": _id(label, F.coalesce(x[by], F.lit(default))), "label": F.lit(label), by: x[by], "ord": ((k + 2) * 1000 + i).cast("bigint")} | ({extra: x[extra]} if extra else {}))))

    all_nodes = _present(schemas.NODE, F.array(own, F.when(F.col("Mission.text").isNotNull(), goal)), *[listed(k) for k in range(4)])
    table = records.select(F.explode(all_nodes).alias("n")).select("n.*")
    if companies is None:
        return table
    names = companies.select(F.col("ticker").alias("__ticker"), F.col("name").alias("__name"))
    joined = table.join(names, table["ticker"] == F.col("__ticker"), "left")
    return joined.withColumn("name", F.coalesce("__name", "name")).select(*_NODE_COLUMNS)


def edges(records: DataFrame) -> DataFrame:
    """The edge table of records, by one pass: what a company has, and links to its first objective and first capability."""
    own = F.concat_ws(":", F.lit("Company"), F.col("Company.ticker"))
    edge = lambda src, dst, rel, at: F.struct(src.alias("src"), dst.alias("dst"), F.lit(rel).alias("rel"), at.cast("bigint").alias("ord"))
    first = {"Capability": ("StrategicObjective", "text", "supportsObjective"), "Initiative": ("Capability", "name", "initiativeEnables")}
    has = F.when(F.col("Mission.text").isNotNull(), edge(own, F.concat_ws(":", F.lit("Mission"), F.col("Company.ticker"), F.lit("mission")), "hasMission", F.lit(1)))

    def of(k: int) -> list[Column]:
        label, by, default, rel, _ = _PARTS[k]
        me = lambda x: _id(label, F.coalesce(x[by], F.lit(default)))
        at = lambda i: (k + 2) * 1000 + i * 2
        out = [_listed(label, lambda x, i: edge(own, me(x), rel, at(i)))]
        if label in first:
            target, name, link = first[label]
            head = F.get(target, F.lit(0))
            end = _id(target, F.coalesce(head[name], F.lit("")))
            out.append(_listed(label, lambda x, i: F.when(head.isNotNull(), edge(me(x), end, link, at(i) + 1))))
        return out

    parts = [F.array(has), *[p for k in range(4) for p in of(k)]]
    return records.select(F.explode(_present(schemas.EDGE, *parts)).alias("e")).select("e.*")
