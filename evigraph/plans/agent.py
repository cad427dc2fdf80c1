"""Questions in words: a rule-based router to the graph questions, text blocks of results, answers with cited documents.

There is no language model: the route follows the question's words, and where that finds nothing the names of the graph that stand in it; the answer is put
together from the result blocks.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import AgentConfig, LinkerConfig
from ..operators import graph, linking
from ..operators.graph import Graph
from ..schemas import LABEL_TYPES

TYPE_WORDS = {"gene": "gene", "disease": "disease", "drug": "chemical", "chemical": "chemical", "compound": "chemical", "process": "biological_process", "cell": "cell_type", "organism": "organism", "tissue": "anatomy", "organ": "anatomy"}
# The lines of a result block.
RULE = "━" * 52
TITLE = "RESULT {} (ISOLATED - DO NOT MIX WITH OTHER RESULTS)"
NAME = "ENTITY NAME (use this exact name): "
DOCUMENTS, SENTENCES, DOCUMENT_IDS = "Documents: ", "Sentences: ", "Document IDs: [{}]"
EVIDENCE = "Evidence ({} samples from {} co-occurring sentences - describe ONLY what these say):"
END = "END RESULT {}"
NOTHING = "No results found in knowledge graph."
BAD_PAIR = "Error: name two entities, divided by a comma."

#: Gives the concepts of a term, none if it is not linked.
Linker = Callable[[str], list[str]]

#: Tools by name: what they ask of the graph. A term that is linked to a concept is matched by it, others by name.
TOOLS: dict[str, Callable[..., DataFrame]] = {
    "FindGenesForDisease": lambda g, c, k, disease: graph.disease_genes(g, disease, cuis=k(disease), min_evidence=c.min_evidence, limit=c.max_results),
    "FindDiseasesForGene": lambda g, c, k, gene: graph.gene_diseases(g, gene, cuis=k(gene), min_evidence=c.min_evidence, limit=c.max_results),
    "FindEntityNeighbors": lambda g, c, k, entity, entity_type=None: graph.neighbors(g, entity, cuis=k(entity), neighbor_type=entity_type, min_evidence=c.min_evidence, limit=c.max_results),
    "ExplainRelationship": lambda g, c, k, entity_a, entity_b: graph.explain(g, entity_a, entity_b, cuis_a=k(entity_a), cuis_b=k(entity_b)).where("found"),
    "FindSharedNeighbors": lambda g, c, k, entity_a, entity_b, neighbor_type=None: graph.shared_neighbors(g, entity_a, entity_b, cuis_a=k(entity_a), cuis_b=k(entity_b), neighbor_type=neighbor_type, min_evidence=c.min_evidence, limit=c.max_results),
}


def no_concepts(term: str) -> list[str]:
    return []


def split_pair(text: str) -> tuple[str, str] | None:
    """Two entities divided at the first comma."""
    a, comma, b = text.partition(",")
    return (a.strip(), b.strip()) if comma else None


def _type_in(question: str) -> str | None:
    words = re.findall(r"[a-z]+", question.lower())
    return next((kind for w in words for stem, kind in TYPE_WORDS.items() if w in (stem, f"{stem}s", f"{stem}es")), None)


def route(question: str) -> tuple[str, dict]:
    """The tool for a question and its arguments."""
    q = question.strip().rstrip("?.! ")
    if m := re.search(r"(?i)\b(?:relationship|relation|connection|link)s? between (.+?) and (.+)$", q):
        return "ExplainRelationship", {"entity_a": m[1].strip(), "entity_b": m[2].strip()}
    if m := re.search(r"(?i)\bboth (.+?) and (.+)$", q) or re.search(r"(?i)\bconnects? (.+?) and (.+)$", q):
        return "FindSharedNeighbors", {"entity_a": m[1].strip(), "entity_b": m[2].strip(), "neighbor_type": _type_in(q[: m.start()])}
    kind, about = _type_in(q), r"(?:associated with|linked to|related to|involved in|involve|for|with|of|in)"
    m = re.search(rf"(?i)\b{about} (.+)$", q)
    entity = (m[1] if m else re.sub(r"(?i)^(what|which|who|tell me|show)\b( is| are| about)?", "", q)).strip()
    entity = re.sub(rf"(?i)^{about} |\s+{about}$", "", entity)
    named = re.match(r"(?i)(disease|gene) (.+)$", entity)
    if named and kind == "gene" and named[1].lower() == "disease":
        return "FindGenesForDisease", {"disease": named[2]}
    if named and kind == "disease" and named[1].lower() == "gene":
        return "FindDiseasesForGene", {"gene": named[2]}
    return "FindEntityNeighbors", {"entity": entity, "entity_type": kind}


#: Words of the longest name that is looked for in a question.
NAME_WORDS = 6


def recognised(g: Graph, question: str) -> list[str]:
    """Names of the graph that stand in a question as runs of its words, in order; the longest where some overlap."""
    words = re.findall(r"[^\s?!.,;:\"()]+", question.lower())
    runs = {" ".join(words[i:j]): (i, j) for i in reversed(range(len(words))) for j in range(i + 1, min(i + NAME_WORDS, len(words)) + 1)}
    rows = g.vertices.where(F.lower("name").isin(list(runs))).select(F.lower("name").alias("name")).distinct().collect()  # no more than runs
    taken: list[tuple[int, int]] = []
    for i, j in sorted((runs[r["name"]] for r in rows), key=lambda x: (x[0] - x[1], x[0])):
        if all(j <= a or b <= i for a, b in taken):
            taken.append((i, j))
    return [" ".join(words[i:j]) for i, j in sorted(taken)]


def route_by_names(g: Graph, question: str) -> tuple[str, dict] | None:
    """The tool for a question by the names of the graph that it holds, however it is phrased; None if it holds none."""
    names, kind = recognised(g, question), _type_in(question)
    if len(names) > 1:
        shared = kind or re.search(r"(?i)\b(both|share[sd]?|common|between them|connect\w*)\b", question)
        return ("FindSharedNeighbors", {"entity_a": names[0], "entity_b": names[1], "neighbor_type": kind}) if shared else ("ExplainRelationship", {"entity_a": names[0], "entity_b": names[1]})
    return ("FindEntityNeighbors", {"entity": names[0], "entity_type": kind}) if names else None


def _filled(template: str, *values: Column) -> Column:
    return F.format_string(template.replace("{}", "%s"), *values)


def blocks(rows: DataFrame, order: list, most_ids: int = 10) -> DataFrame:
    """``pos, block``: each result as text of its own, in order."""
    name = F.coalesce(*[F.col(c) for c in ("neighbor_name", "entity_a_name", "entity_b_name") if c in rows.columns])
    ranked = rows.withColumn("pos", F.row_number().over(Window.orderBy(*order)))  # no more rows than a question returns
    n, blank, nothing = F.col("pos").cast("string"), F.lit(""), F.array().cast("array<string>")
    ids, shown = F.slice("sample_doc_ids", 1, most_ids), F.size("evidence_sentences")
    quoted = F.transform("evidence_sentences", lambda s, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit('. "'), s, F.lit('"')))
    lines = F.concat(
        F.array(F.lit(RULE), _filled(TITLE, n), F.lit(RULE), blank, F.concat(F.lit(NAME), name), blank, F.concat(F.lit(DOCUMENTS), F.col("docs_count").cast("string")), F.concat(F.lit(SENTENCES), F.col("sent_count").cast("string"))),
        F.when(F.size(ids) > 0, F.array(_filled(DOCUMENT_IDS, F.array_join(ids, ", ")))).otherwise(nothing),
        F.when(shown > 0, F.concat(F.array(blank, _filled(EVIDENCE, shown.cast("string"), F.col("sent_count").cast("string"))), quoted)).otherwise(nothing),
        F.array(blank, _filled(END, n), blank),
    )
    return ranked.select("pos", F.array_join(lines, "\n").alias("block"))


def result_text(i: int, r: dict, most_ids: int = 10) -> str:
    """The block of a result that is with the driver already."""
    ids, evidence = r["sample_doc_ids"][:most_ids], r["evidence_sentences"]
    lines = [RULE, TITLE.format(i), RULE, "", NAME + str(r.get("neighbor_name") or r.get("entity_a_name")), "", f"{DOCUMENTS}{r['docs_count']}", f"{SENTENCES}{r['sent_count']}"]
    lines += [DOCUMENT_IDS.format(", ".join(map(str, ids)))] if ids else []
    lines += ["", EVIDENCE.format(len(evidence), r["sent_count"]), *(f'  {k}. "{s}"' for k, s in enumerate(evidence, 1))] if evidence else []
    return "\n".join([*lines, "", END.format(i), ""])


def cited(ids: list[str], answer: str) -> list[str]:
    """Ids that the answer names as whole words; all if it names none."""
    found = [d for d in ids if re.search(rf"\b{re.escape(d)}\b", answer)]
    return found or ids


def linker(aliases: DataFrame | None, config: LinkerConfig = LinkerConfig(least_similarity=0.7)) -> Linker:
    """Terms of questions linked by an alias table, also where they are written a little otherwise."""
    return lambda term: linking.concepts(term, aliases, config)


def _run(g: Graph, config: AgentConfig, concepts: Linker, tool: str, arguments: dict) -> list[dict]:
    return [r.asDict() for r in TOOLS[tool](g, config, concepts, **arguments).collect()]  # as many as a question returns


def ask(g: Graph, question: str, history: list[dict] | None = None, config: AgentConfig = AgentConfig(), concepts: Linker = no_concepts) -> dict:
    """``question, answer, doc_ids, messages``; ``answer, error`` and no messages if the graph cannot be read."""
    messages = [*(history or [])[-config.max_history_messages :], {"role": "user", "content": question}]
    try:
        tool, arguments = route(question)
        rows = _run(g, config, concepts, tool, arguments)
        if not rows and (other := route_by_names(g, question)) and other != (tool, arguments):
            tool, arguments = other
            rows = _run(g, config, concepts, tool, arguments)
        output = "\n".join(result_text(i, r, config.max_doc_ids_per_result) for i, r in enumerate(rows, 1)) or NOTHING
    except (PySparkException, Py4JError) as e:
        return {"question": question, "answer": f"The question failed: {e}", "doc_ids": [], "error": str(e)}
    ids = list(dict.fromkeys(str(d) for r in rows for d in r["sample_doc_ids"][: config.max_doc_ids_per_result]))
    name = lambda r: r.get("neighbor_name") or r.get("entity_a_name")
    total = sum(r["docs_count"] for r in rows)
    bullets = [f"- **{name(r)}** -- {r['docs_count']} documents; {(r['evidence_sentences'] or ['no evidence sentence'])[0]} [{', '.join(r['sample_doc_ids'])}]" for r in rows]
    answer = "\n\n".join((f"1. BRIEF SUMMARY\n{len(rows)} results with {total} documents in all." if rows else f"1. BRIEF SUMMARY\n{NOTHING}", f"2. SELECTION RATIONALE\nAll results of {tool} with at least {config.min_evidence} documents, strongest first.", "3. DETAILED RESULTS\n" + "\n".join(bullets)))
    return {"question": question, "answer": answer, "doc_ids": cited(ids, answer), "messages": [*messages, {"role": "assistant", "content": answer}], "tool": tool, "tool_output": output}


def grounding(answer: str, tool_output: str) -> dict:
    """Bulleted names of an answer against the names that the tool gave, without regard to case and hyphens."""
    plain = lambda s: s.lower().replace("-", " ").strip()
    named = re.findall(r"(?m)^- \*\*(.+?)\*\*", answer)
    known = {plain(x) for x in re.findall(r"(?m)^" + re.escape(NAME) + "(.+)$", tool_output)}
    invented = [x for x in named if plain(x) not in known]
    return {"named": len(named), "available": len(known), "invented": invented}


def last_messages(conversations: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` turns of each conversation."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text")
    return conversations.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


ENTITY_TYPES = tuple(dict.fromkeys(LABEL_TYPES.values()))
