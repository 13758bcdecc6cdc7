"""Type groups, tokens, rendered text and parsed model output."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from schemaloom.functions.constants import (
    AFFINITY_RULES,
    DEFAULT_INSTRUCTION,
    EXACT_TYPE_GROUPS,
    SEPARATORS,
)


def affinity(declared: Column) -> Column:
    """Type group of a declared type by ordered substring rules."""
    upper = F.upper(declared)
    out = F.when(declared.isNull() | (declared == ""), F.lit("BLOB"))
    for needles, group in AFFINITY_RULES:
        hit = reduce(lambda a, b: a | b, [upper.contains(n) for n in needles])
        out = out.when(hit, F.lit(group))
    return out.otherwise(F.lit("NUMERIC"))


def exact_type(declared: Column) -> Column:
    """``struct(type, typegroup)`` by exact name, TEXT when the name is unknown."""
    upper = F.upper(declared)
    groups = F.create_map(*[F.lit(x) for pair in EXACT_TYPE_GROUPS.items() for x in pair])
    group = F.try_element_at(groups, upper)
    return F.struct(
        F.when(group.isNotNull(), upper).otherwise(F.lit("TEXT")).alias("type"),
        F.coalesce(group, F.lit("TEXT")).alias("typegroup"),
    )


def make_column(name: Column, declared: Column, pk: Column | int = 0, not_null: Column | bool = False) -> Column:
    """Column struct of a synthetic table."""
    typed = exact_type(declared)
    pk = F.lit(pk) if isinstance(pk, int) else pk
    not_null = F.lit(not_null) if isinstance(not_null, bool) else not_null
    return F.struct(
        name.alias("name"),
        typed["type"].alias("type"),
        typed["typegroup"].alias("typegroup"),
        not_null.alias("not_null"),
        pk.cast("int").alias("pk"),
    )


def fixed_column(name: str, declared: str) -> Column:
    """``make_column`` of a nullable non-key column whose name and type are known."""
    group = EXACT_TYPE_GROUPS.get(declared, "TEXT")
    kind = declared if declared in EXACT_TYPE_GROUPS else "TEXT"
    return F.expr(
        f"named_struct('name', '{name}', 'type', '{kind}', 'typegroup', '{group}', 'not_null', false, 'pk', 0)"
    )


def raw_tokens(text: Column) -> Column:
    """Lower-cased words with ``_`` as a separator; may hold empty strings at the ends.

    Lower-casing comes first, so camelCase never splits; punctuation stays.
    Explode it with ``explode_outer`` and filter: for ``explode`` the optimizer
    adds a non-empty test below the generator and splits every text again.
    """
    return F.split(F.lower(text), SEPARATORS)


def tokens(text: Column) -> Column:
    """``raw_tokens`` without the empty strings."""
    return F.array_remove(raw_tokens(text), "")


def first_token(text: Column) -> Column:
    """First of ``tokens``, null if there is none; the rest of the text is not split."""
    return F.get(F.array_remove(F.split(F.lower(text), SEPARATORS, 3), ""), F.lit(0))


def column_phrase(name: Column, typegroup: Column, pk: Column) -> Column:
    """Retrieval text of one column."""
    base = F.concat(F.lit("column "), name, F.lit(" type "), typegroup)
    return F.concat(base, F.when(pk > 0, F.lit(" primary key")).otherwise(F.lit("")))


def foreign_key_phrase(ref_col: Column, ref_table: Column) -> Column:
    """Retrieval text of one foreign key; it names the referenced column."""
    return F.concat(F.lit("foreign key "), ref_col, F.lit(" references "), ref_table)


def prompt_column_line(name: Column, declared: Column, not_null: Column, pk: Column, fix_not_null: bool = True) -> Column:
    """Prompt line of one column.

    The published layout marks *nullable* columns NOT NULL; ``fix_not_null=False``
    reproduces that. Only the first column of a key is marked.
    """
    marked = not_null if fix_not_null else ~not_null
    return F.concat(
        F.lit("("), name, F.lit(": "), F.upper(declared), F.lit(","),
        F.when(pk == 1, F.lit(" PRIMARY KEY,")).otherwise(F.lit("")),
        F.when(marked, F.lit(" NOT NULL")).otherwise(F.lit("")),
        F.lit("),\n"),
    )


def chat_messages(schema_text: Column, question: Column, instruction: str = DEFAULT_INSTRUCTION) -> Column:
    """System instruction, schema and question as ordered messages."""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(
        message("system", F.lit(instruction)),
        message("system", schema_text),
        message("user", question),
    )


def table_refs(sql: Column) -> Column:
    """Distinct table names a statement reads; the second part of a dotted name counts.

    The statement is cut into words; a word that ends in one of the two keywords is
    followed by a path, read up to the first character that cannot belong to one.
    """
    close_dots = F.regexp_replace(F.lower(F.coalesce(sql, F.lit(""))), r"(?U)\s*\.\s*", ".")
    words = F.filter(F.split(close_dots, r"(?U)\s+"), lambda w: w != "")
    after = F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1)))

    def name(word: Column, path: Column) -> Column:
        chain = F.translate(F.regexp_extract(path, r"(?U)^[\w.\"`\[\]]+", 0), '"`[]', "")
        parts = F.transform(F.split(chain, r"\."), lambda p: F.when(p.rlike(r"(?U)^[a-z_]\w*$"), p).otherwise(F.lit("")))
        schema, table = F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
        found = F.when(schema == "", F.lit("")).when(table == "", schema).otherwise(table)
        return F.when(word.endswith("from") | word.endswith("join"), found).otherwise(F.lit(""))

    named = F.zip_with(words, after, lambda w, p: name(w, F.coalesce(p, F.lit(""))))
    picked = F.filter(named, lambda n: n != "")
    return F.array_distinct(picked)


def tool_sql(arguments: Column) -> Column:
    """``sql`` field of a tool call's JSON arguments, null when it cannot be read."""
    return F.from_json(arguments, "sql string")["sql"]


def percent(part: Column, whole: Column, digits: int = 6) -> Column:
    """100 * part / whole, null for an empty whole."""
    return F.round(F.lit(100.0) * F.try_divide(part.cast("double"), whole.cast("double")), digits)


def ratio(part: Column, whole: Column, digits: int = 6) -> Column:
    """part / whole, null for an empty whole."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), digits)
