"""Symbol tables: extraction from source, resolution of references, queries, alias upkeep."""

from __future__ import annotations

import ast
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.window import Window as W

from veilframe.functions.text import digest, normalize_term
from veilframe.sources.scratch import ship

NODE = "node long, parent long, kind string, name string, role string, scope array<long>, start_line long, start_column long, end_line long, end_column long"


def python_nodes(source: str) -> Iterator[tuple]:
    """Syntax nodes of a Python text in depth-first order: ``(node, parent, kind, name, role, scope, range...)``.

    Declarations and references have a name and a role; a scope is the path of enclosing callables and classes.
    """
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return
    stack: list[tuple] = [(tree, None, [])]
    number = 0
    while stack:
        node, parent, scope = stack.pop()
        mine, number = number, number + 1
        name = role = None
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            name, role = node.name, "declaration"
        elif isinstance(node, ast.arg):
            name, role = node.arg, "declaration"
        elif isinstance(node, ast.Name):
            name, role = node.id, "reference" if isinstance(node.ctx, ast.Load) else "declaration"
        if isinstance(node, ast.Module) or hasattr(node, "lineno"):
            place = (getattr(node, "lineno", 1), getattr(node, "col_offset", 0), getattr(node, "end_lineno", 1), getattr(node, "end_col_offset", 0))
            yield mine, parent, type(node).__name__, name, role, scope, *place
        inner = [*scope, mine] if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)) else scope
        stack += [(c, mine, inner) for c in reversed(list(ast.iter_child_nodes(node)))]


def parse_python(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, node...)``: the syntax nodes of every document; one that does not parse has none."""
    spark = docs.sparkSession
    ship(spark)

    @udtf(returnType=NODE)
    class Nodes:
        def eval(self, source: str):  # noqa: ANN201
            from veilframe.operators.symbols import python_nodes as nodes

            yield from nodes(source or "")

    spark.udtf.register("veilframe_python_nodes", Nodes)
    docs.select(F.col(key), F.col(text).alias("source")).createOrReplaceTempView("veilframe_sources")
    return spark.sql(f"SELECT s.`{key}`, n.* FROM veilframe_sources s, LATERAL veilframe_python_nodes(s.source) n")


def resolve(references: DataFrame, declarations: DataFrame, key: str = "doc_id") -> DataFrame:
    """Binds references to declarations of their name, by tests in this order: visibility, kind, qualifier, arity, overload, deepest scope, latest before the reference.

    ``references(key, ref_id, name, scope, at)``, ``declarations(key, symbol_id, name, scope, at)``; scopes are arrays and a declaration is
    visible where its scope is a prefix of the reference's. Optional columns, each null where it does not matter: of references
    ``kinds`` (those that fit), ``qualifier`` (labels that the declaration's ``labels`` end with; it makes declarations of any scope visible), ``enclosing_type`` and
    ``receiver_type`` (declarations of this ``owner_type``; the latter is the only way to members), ``arity`` and ``argument_types``; of declarations ``kind``, ``labels``, ``owner_type``,
    ``min_arity``, ``max_arity`` (null: any number), ``parameter_types``. An arity that no candidate takes decides nothing. Overloads are scored by equal types; a single best one wins.

    Result ``(key, ref_id, symbol_id, role)``: bound; unresolved if several are as good; external if none is left.
    """
    r = _with(references, kinds="array<string>", qualifier="array<string>", enclosing_type="string", receiver_type="string", arity="int", argument_types="array<string>")
    d = _with(declarations, kind="string", labels="array<string>", owner_type="string", min_arity="int", max_arity="int", parameter_types="array<string>")
    d = d.select(*(F.col(c).alias(f"d_{c}") for c in (key, "symbol_id", "name", "scope", "at", "kind", "labels", "owner_type", "min_arity", "max_arity", "parameter_types")))
    inside = F.slice("scope", F.lit(1), F.size("d_scope")) == F.col("d_scope")
    member = F.col("d_owner_type").eqNullSafe(F.col("receiver_type"))
    own = F.coalesce(F.col("d_owner_type") == F.col("enclosing_type"), F.lit(False))
    seen = F.when(F.col("receiver_type").isNotNull(), member).when(F.col("qualifier").isNotNull(), True).otherwise(inside | own)
    n = F.size("qualifier")
    labelled = F.col("qualifier").isNull() | F.coalesce((F.size("d_labels") >= n) & (F.slice("d_labels", F.size("d_labels") - n + 1, n) == F.col("qualifier")), F.lit(False))
    fits = seen & (F.col("kinds").isNull() | F.coalesce(F.array_contains("kinds", F.col("d_kind")), F.lit(False))) & labelled
    # a qualifier longer than the labels would slice from a negative place, so the tests run after the join of names
    named = r.join(d, (F.col(key) == F.col(f"d_{key}")) & (F.col("name") == F.col("d_name"))).where(fits)
    each = W.partitionBy(key, "ref_id")
    takes = F.coalesce((F.col("d_min_arity") <= F.col("arity")) & (F.col("d_max_arity").isNull() | (F.col("arity") <= F.col("d_max_arity"))), F.lit(False))
    sized = named.withColumn("_takes", takes).withColumn("_any", F.max("_takes").over(each)).where("arity is null or _takes or not _any")
    pairs = F.arrays_zip(F.col("argument_types").alias("a"), F.col("d_parameter_types").alias("p"))
    same = F.when(F.size("d_parameter_types") >= F.size("argument_types"), F.size(F.filter(pairs, lambda x: x["a"] == x["p"])))
    scored = sized.withColumn("_score", F.when(F.col("argument_types").isNotNull(), same)).withColumn("_best", F.max("_score").over(each))
    alone = F.sum(F.when(F.col("_score") == F.col("_best"), 1).otherwise(0)).over(each) == 1
    chosen = scored.withColumn("_alone", alone & (F.col("_best") > 0)).where("not coalesce(_alone, false) or _score = _best")
    before = F.when(F.col("d_at") <= F.col("at"), F.col("d_at")).otherwise(F.lit(-1))
    best = chosen.withColumn("_r", F.rank().over(each.orderBy(F.size("d_scope").desc(), before.desc()))).where("_r = 1")
    found = best.groupBy(key, "ref_id").agg(F.count_distinct("d_symbol_id").alias("n"), F.min("d_symbol_id").alias("symbol_id"))
    joined = references.select(key, "ref_id").join(found, [key, "ref_id"], "left")
    role = F.when(F.col("n").isNull(), "external").when(F.col("n") > 1, "unresolved").otherwise("bound")
    return joined.select(key, "ref_id", F.when(F.col("n") == 1, F.col("symbol_id")).alias("symbol_id"), role.alias("role"))


def _with(rows: DataFrame, **columns: str) -> DataFrame:
    """The rows with columns that they lack as nulls."""
    return rows.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in rows.columns})


def stable_id(kind: str, *parts: str):  # noqa: ANN201
    return F.concat(F.lit(f"{kind}_"), F.substring(digest(F.lit(kind), *(F.col(p).cast("string") for p in parts)), 1, 16))


def declaration_ordinals(symbols: DataFrame) -> DataFrame:
    """Adds ``ordinal``: which of a document's declarations of a kind and qualified name a symbol is."""
    return symbols.withColumn("ordinal", F.row_number().over(W.partitionBy("doc_id", "kind", "qualified_name").orderBy("start")) - 1)


def references_of(occurrences: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols with the number of their references and the documents of these in order, 0 and empty without any."""
    counted = occurrences.where("role = 'reference'").groupBy("symbol_id").agg(F.count(F.lit(1)).alias("n_references"), F.array_join(F.array_sort(F.collect_set(F.col("doc_id").cast("string"))), ",").alias("documents"))
    return symbols.join(counted, "symbol_id", "left").withColumns({"n_references": F.coalesce("n_references", F.lit(0)).cast("long"), "documents": F.coalesce("documents", F.lit(""))})


def occurrences_of(occurrences: DataFrame, wanted: DataFrame) -> DataFrame:
    """All occurrences of wanted ``symbol_id``, in order of symbol, document and offset."""
    return occurrences.join(wanted.select("symbol_id").distinct(), "symbol_id", "left_semi").orderBy("symbol_id", "doc_id", "start")


def accepted_pairs(occurrences: DataFrame, aliases: DataFrame) -> DataFrame:
    """``(original, alias)`` of accepted aliases that occur anywhere; aliases are the small side, which adaptive execution sees."""
    accepted = aliases.where("status = 'accepted'").select("symbol_id", "original", "alias")
    return occurrences.select("symbol_id").join(accepted, "symbol_id").select("original", "alias").distinct()


def keep_ids(old: DataFrame, new: DataFrame) -> DataFrame:
    """New symbols with the ids of old ones: those at the same node first, then those of equal name and range."""
    by_node = old.select("doc_id", "node_id", F.col("symbol_id").alias("id_node"))
    by_range = old.groupBy("doc_id", "name", "start", "end").agg(F.min("symbol_id").alias("id_range"))
    joined = new.join(by_node, ["doc_id", "node_id"], "left").join(by_range, ["doc_id", "name", "start", "end"], "left")
    return joined.withColumn("symbol_id", F.coalesce("id_node", "id_range", "symbol_id")).drop("id_node", "id_range")


def rebind(occurrences: DataFrame, bindings: DataFrame) -> DataFrame:
    """Occurrences with the symbols that stored bindings give them, where place, name and content are still the same."""
    b = bindings.select("doc_id", "start", "end", "name", "content_hash", F.col("symbol_id").alias("b_symbol"))
    joined = occurrences.join(b, ["doc_id", "start", "end", "name", "content_hash"], "left")
    return joined.withColumns({"symbol_id": F.coalesce("b_symbol", "symbol_id"), "role": F.when(F.col("b_symbol").isNotNull() & (F.col("role") == "unresolved"), "reference").otherwise(F.col("role"))}).drop("b_symbol")


def stale_groups(bindings: DataFrame, documents: DataFrame) -> DataFrame:
    """``(symbol_id)`` of bindings whose document is gone or has other content, null-safe."""
    d = documents.select(F.col("doc_id").alias("d_id"), F.col("content_hash").alias("d_hash"))
    return bindings.join(d, F.col("doc_id") == F.col("d_id"), "left").where(F.col("d_id").isNull() | ~F.col("content_hash").eqNullSafe(F.col("d_hash"))).select("symbol_id").distinct()


def alias_conflicts(aliases: DataFrame) -> DataFrame:
    """``(alias_norm, n)``: accepted aliases that several different names share."""
    known = aliases.where("status = 'accepted'").groupBy(normalize_term(F.col("alias")).alias("alias_norm")).agg(F.count_distinct(normalize_term(F.col("original"))).alias("n"))
    return known.where("n > 1")


def snapshot(occurrences: DataFrame) -> DataFrame:
    """One row of counts, in one pass."""
    role = lambda r: F.count_if(F.col("role") == r).alias(f"n_{r}")
    return occurrences.agg(F.count(F.lit(1)).alias("n_occurrences"), F.count_distinct("symbol_id").alias("n_symbols"), role("declaration"), role("reference"), role("unresolved"), role("external"))


def project_qualified(names: DataFrame, shown: DataFrame) -> DataFrame:
    """Adds ``projected`` to ``names(qualified_name, own)``: the last part as shown, then the longest known prefix as shown.

    ``shown(qualified_name, projected_name)`` has the projection of each container; parts are joined by ``::`` or ``.``.
    """
    head = F.regexp_extract("qualified_name", r"^(.*?)((?:::|\.)?)([^:.]*)$", 1)
    joint = F.regexp_extract("qualified_name", r"^(.*?)((?:::|\.)?)([^:.]*)$", 2)
    cut = names.withColumns({"_head": head, "_joint": joint})
    known = shown.select(F.col("qualified_name").alias("_prefix"), "projected_name").distinct()
    heads = cut.select("_head").distinct().withColumn("_prefix", F.explode(name_prefixes(F.col("_head"))))
    best = heads.join(known, "_prefix").groupBy("_head").agg(F.max_by(F.struct("_prefix", "projected_name"), F.length("_prefix")).alias("_b"))
    joined = cut.join(best, "_head", "left")
    front = F.when(F.col("_b").isNull(), F.col("_head")).otherwise(F.concat("_b.projected_name", F.substring(F.col("_head"), F.length("_b._prefix") + 1, F.length("_head"))))
    return joined.withColumn("projected", F.concat(front, "_joint", "own")).drop("_head", "_joint", "_b")


def name_prefixes(head):  # noqa: ANN001, ANN201
    """Prefixes of a qualified name that end at a joint, the name itself included."""
    parts = F.split(head, r"(?<=::)|(?<=\.)")
    joined = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.regexp_replace(F.array_join(F.slice(parts, F.lit(1), n), ""), r"(::|\.)$", ""))
    return F.filter(joined, lambda p: p != "")


def linked_aliases(links: DataFrame, aliases: DataFrame) -> DataFrame:
    """``(symbol_id, other_id, alias)``: accepted aliases of symbols that share a canonical one: ``links(canonical, linked)`` with itself."""
    accepted = aliases.where("status = 'accepted'").select(F.col("symbol_id").alias("other_id"), "alias")
    # only members with an alias are the other side, so a group of many members with few aliases stays linear
    named = links.select("canonical", F.col("linked").alias("other_id")).distinct().join(accepted, "other_id")
    members = links.select("canonical", F.col("linked").alias("symbol_id")).distinct()
    return members.join(named, "canonical").where("symbol_id <> other_id").select("symbol_id", "other_id", "alias").distinct()


def spread_aliases(components: DataFrame, aliases: DataFrame) -> DataFrame:
    """``(symbol_id, alias)`` for every member of a component that has an accepted alias: the one of the earliest revision, then smallest id.

    ``components(node, root)``, ``aliases(symbol_id, alias, status, revision)``.
    """
    accepted = aliases.where("status = 'accepted'").join(components, F.col("symbol_id") == F.col("node"))
    canonical = accepted.groupBy("root").agg(F.min(F.struct("revision", "symbol_id", "alias")).alias("_c")).select("root", F.col("_c.alias").alias("alias"))
    return components.join(canonical, "root").select(F.col("node").alias("symbol_id"), "alias")


def calls(nodes: DataFrame, kinds: tuple[str, ...] = ("call_expression", "macro_invocation")) -> DataFrame:
    """``(node_id, call_id)`` of nodes whose parent is a call."""
    parents = nodes.where(F.col("kind").isin(*kinds)).select(F.col("node_id").alias("call_id"))
    return nodes.join(parents, F.col("parent_id") == F.col("call_id")).select("node_id", "call_id")


def same_shape(symbols: DataFrame, wanted: DataFrame) -> DataFrame:
    """Symbols of the kind, qualified name and language family of any wanted ``symbol_id``; C-like languages are one family."""
    family = F.when(F.col("language").isin("c", "cpp", "objc", "objcpp"), "c-family").otherwise(F.col("language"))
    shaped = symbols.withColumn("family", family)
    shapes = shaped.join(wanted.select("symbol_id"), "symbol_id", "left_semi").select("kind", "qualified_name", "family").distinct()
    return shaped.join(shapes, ["kind", "qualified_name", "family"], "left_semi").select("symbol_id", "kind", "qualified_name", "family")


def replaced_components(replacements: DataFrame, ids: DataFrame) -> DataFrame:
    """Replacements whose key ``semantic:<id>:<rest>`` names one of ``ids(symbol_id)``: the id is cut out, so it is an equi-join."""
    named = replacements.where(F.col("stable_key").startswith("semantic:")).withColumn("symbol_id", F.split_part("stable_key", F.lit(":"), F.lit(2)))
    return named.join(ids.select("symbol_id").distinct(), "symbol_id", "left_semi")


def bound_replacements(replacements: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Replacements that stand exactly where a bound occurrence does."""
    bound = occurrences.where("symbol_id is not null").select("doc_id", F.col("start").alias("original_start"), F.col("end").alias("original_end")).distinct()
    return replacements.join(bound, ["doc_id", "original_start", "original_end"], "left_semi")
