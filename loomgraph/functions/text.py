"""Cleaning of names, tags, paths and answers of language models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_first(line: Column, separator: str = ",") -> Column:
    """Array of what is before and after the first separator, without a trailing carriage return."""
    return F.split(F.regexp_replace(line, r"\r$", ""), separator, 2)


def repair_csv_name(name: Column) -> Column:
    """A name that held the separators of its file."""
    return F.replace(F.translate(name, ",()", ""), F.lit("/"), F.lit(" or "))


def clean_tag(tag: Column) -> Column:
    """Trimmed, capitals after white space only."""
    return F.initcap(F.trim(tag))


def strip_numbering(name: Column) -> Column:
    """Without leading number, single blanks, capitals."""
    return F.initcap(F.trim(F.regexp_replace(F.regexp_replace(name, r"^\d+\s*[.)\-_:]*\s*", ""), r"\s+", " ")))


def detector_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(name, "/-()", "    "), r"\s+", " "))


def name_and_description(text: Column) -> Column:
    parts = F.split(text, ":", 2)
    return F.struct(F.trim(parts[0]).alias("name"), F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("description"))


def tags(text: Column) -> Column:
    return F.split(text, r" [|] ")


def path_part(path: Column, from_end: int) -> Column:
    """Part of a path, 1 for the last; null if there are fewer."""
    return F.try_element_at(F.split(path, "/"), F.lit(-from_end))


def human_bytes(n: Column) -> Column:
    """Bytes with the largest fitting unit."""
    out = None
    for i, unit in reversed(list(enumerate(["B", "KB", "MB", "GB", "TB", "PB"]))):
        text = F.format_string(f"%.1f {unit}", n.cast("double") / F.lit(float(1024**i)))
        out = F.when(n >= 1024**i, text) if out is None else out.when(n >= 1024**i, text)
    return out.otherwise(F.format_string("%.1f B", n.cast("double")))


def padded_frame(frame: Column) -> Column:
    return F.lpad(frame.cast("string"), 6, "0")


def is_final_instance_file(name: Column) -> Column:
    return name.rlike(r"^\d+_final_instance\.json$")


def yes_no_class(answer: Column) -> Column:
    """(yes, class) of an answer `yes, chair`."""
    parts = F.split(answer, ", ", 2)
    return F.struct((F.lower(parts[0]) == "yes").alias("yes"), F.get(parts, F.lit(1)).alias("class"))


def fenced(text: Column) -> Column:
    """Content of the first fenced JSON block, else the whole text."""
    block = F.regexp_extract(text, r"(?s)```json\s*(.*?)\s*```", 1)
    return F.when(block != "", block).otherwise(text)


def repair_json(text: Column) -> Column:
    """Common slips of a model's JSON: wrong separators, trailing commas, curly quotes, stray brackets and quotes, open quotes.

    A quote that was put behind the comma at the end of a line goes before it; a quote alone between blanks within a text
    goes. Both leave valid JSON as it is, in which a quote between blanks stands beside a separator.
    """
    t = F.translate(text, "“”‘’", "\"\"''")
    t = F.regexp_replace(t, r';\s*"', ', "')
    t = F.translate(t, ");", "")
    t = F.regexp_replace(t, r",\s*([}\]])", "$1")
    t = F.regexp_replace(t, r'(?m)("\w+"\s*:\s*"[^"\n]*),"[ \t]*$', '$1",')
    t = F.regexp_replace(t, r'(?<=[^\s:,\[{]) " (?=[^\s:,\]}])', " ")
    t = F.regexp_replace(t, r'("\w+"\s*:\s*"[^"\n]*[^"\s\\,])\s*\n(\s*")', '$1",\n$2')
    t = F.regexp_replace(t, r'("\w+"\s*:\s*"[^"\n]*[^"\s\\,]),[ \t]*\n(\s*")', '$1",\n$2')
    return F.regexp_replace(t, r'("\w+"\s*:\s*"[^"\n]*[^"\s\\,}])\s*\n(\s*})', '$1"\n$2')


OBJECT = "struct<name:string,description:string>"


def normal_objects(text: Column) -> Column:
    """Array of (name, description): from a list, or from an object with a single list; null for anything else."""
    as_list = F.when(text.rlike(r"^\s*\["), F.from_json(text, f"array<{OBJECT}>"))
    as_map = F.from_json(text, f"map<string,array<{OBJECT}>>")
    return F.coalesce(as_list, F.when(F.size(as_map) == 1, F.get(F.map_values(as_map), F.lit(0))))


def complete_objects(objects: Column) -> Column:
    """Without those that lack a name or description."""
    return F.filter(objects, lambda o: (F.length(F.trim(o["name"])) > 0) & (F.length(F.trim(o["description"])) > 0))
