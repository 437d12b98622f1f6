"""Text, path, date and JSON expressions. Lengths are code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of slugs that are written in capitals: fixed values.
ACRONYMS = ("ai", "ml", "api", "llm", "gpu", "ui", "ux", "ci", "cd", "aws", "gcp", "seo", "css", "html", "sql", "cli", "sdk", "mcp")
#: Words that YAML would read as something else: fixed values.
RESERVED = ("null", "true", "false", "yes", "no", "on", "off", "nil")


def present(x: Column) -> Column:
    """Null for an empty string: empty counts as missing."""
    return F.nullif(x, F.lit(""))


def title_of(raw: Column, path: Column) -> Column:
    """The first level-one heading of the raw text, else the file name without its first '.md'."""
    name = F.element_at(F.split(path, "/"), -1)
    at = F.instr(name, ".md")
    stem = F.when(at > 0, F.concat(F.substr(name, F.lit(1), at - 1), F.substr(name, at + 3))).otherwise(name)
    return F.when(raw.rlike(r"(?m)^#\s+(.+)$"), F.regexp_extract(raw, r"(?m)^#\s+(.+)$", 1)).otherwise(stem)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def document_text(title: Column, topic: Column, tags: Column, entities: Column, summary: Column, content: Column) -> Column:
    """What a document is embedded by; missing parts vanish, without a summary the content's first 500 characters count."""
    return F.concat_ws(
        " | ",
        F.concat(F.lit("Title: "), present(title)),
        F.concat(F.lit("Topic: "), present(topic)),
        F.when(F.size(tags) > 0, F.concat(F.lit("Tags: "), F.array_join(tags, ", "))),
        F.when(F.size(entities) > 0, F.concat(F.lit("Entities: "), F.array_join(entities, ", "))),
        F.coalesce(present(summary), F.substr(content, F.lit(1), F.lit(500))),
    )


def entity_text(kind: Column, name: Column, description: Column) -> Column:
    return F.concat_ws(". ", F.concat(kind, F.lit(": "), name), present(description))


def question_text(text: Column) -> Column:
    return F.concat(F.lit("Question: "), text)


def slug_of(path: Column) -> Column:
    """The directory right below docs of a README, else null."""
    return present(F.regexp_extract(path, r"(?i)/docs/([^/]+)/README\.md$", 1))


def slug_title(slug: Column) -> Column:
    capital = lambda w: F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.lower(F.substr(w, F.lit(2))))
    return F.array_join(F.transform(F.split(slug, "-"), lambda w: F.when(F.lower(w).isin(*ACRONYMS), F.upper(w)).otherwise(capital(w))), " ")


def truncated_summary(text: Column, most: int = 100) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substr(flat, F.lit(1), F.lit(most - 3)), F.lit("..."))).otherwise(flat)


def short_description(text: Column, label: Column, most: int = 80) -> Column:
    """Hidden for documents, cut after `most` characters."""
    cut = F.when(F.length(text) > most, F.concat(F.substr(text, F.lit(1), F.lit(most)), F.lit("..."))).otherwise(text)
    return F.when(label != "Document", present(cut))


def percent(score: Column) -> Column:
    return F.format_string("%.2f%%", score * 100)


def escaped_cell(text: Column) -> Column:
    return F.replace(text, F.lit("|"), F.lit("\\|"))


def trigger_label(trigger: Column) -> Column:
    return F.initcap(F.replace(trigger, F.lit("_"), F.lit(" ")))


def needs_quotes(value: Column) -> Column:
    """Whether a YAML scalar must be quoted: empty, white space at an edge, special characters, a leading dash, a reserved word."""
    special = value.rlike(r"""[:#\[\]{}!&*,|>'"?%@`\\]""") | value.startswith("-")
    return (value == "") | value.rlike(r"^\s|\s$") | special | F.lower(value).isin(*RESERVED)


def quoted(value: Column) -> Column:
    return F.when(needs_quotes(value), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(value)


def valid_date(text: Column) -> Column:
    """A real calendar date written YYYY-MM-DD."""
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), F.lit(False))


def stripped_link(href: Column) -> Column:
    """Relative links lose '.md'; others stay."""
    return F.when(~href.rlike(r"^(https?:)?//") & href.endswith(".md"), F.substr(href, F.lit(1), F.length(href) - 3)).otherwise(href)


def resolved_path(path: Column, root: str) -> Column:
    """Absolute paths stay, others stand below root."""
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), F.regexp_replace(path, r"^\./", "")))


def inside(path: Column, root: str) -> Column:
    """Root itself or below it; a sibling that shares its beginning isn't."""
    at = root.rstrip("/")
    return (F.rtrim(path, F.lit("/")) == at) | path.startswith(at + "/")


def relative_path(path: Column, root: str) -> Column:
    at = root.rstrip("/") + "/"
    return F.when(path.startswith(at), F.substr(path, F.lit(len(at) + 1))).otherwise(path)


def field(properties: Column, name: str) -> Column:
    """A JSON property as text."""
    return F.get_json_object(properties, f"$.{name}")


def has_field(properties: Column, name: str) -> Column:
    """Whether a JSON object has a key, whatever its value."""
    return F.array_contains(F.json_object_keys(properties), name)
