"""Text forms of a packed context; rows are the few chunks of one answer."""

from __future__ import annotations

import json
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame


def _rows(chunks: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in chunks.collect()]  # bounded by the token budget


def to_json(question: str, chunks: DataFrame) -> str:
    return json.dumps({"query": question, "chunks": _rows(chunks)}, indent=2, ensure_ascii=False, default=str)


def to_xml(question: str, chunks: DataFrame) -> str:
    out = [f"<context query={quoteattr(question)}>"]
    for r in _rows(chunks):
        body = str(r["content"]).replace("]]>", "]]]]><![CDATA[>")
        out.append(f"  <chunk file={quoteattr(str(r['file_path']))} lines=\"{r['start_line']}-{r['end_line']}\" score=\"{r['score']:.4f}\"><![CDATA[{body}]]></chunk>")
    return "\n".join([*out, "</context>"])


def to_markdown(question: str, chunks: DataFrame) -> str:
    out = [f"# Context for: {escape(question)}"]
    for r in _rows(chunks):
        out += [f"\n## {r['file_path']}:{r['start_line']}-{r['end_line']} (score {r['score']:.2f})", f"```{r.get('language') or ''}", str(r["content"]), "```"]
    return "\n".join(out)


def profile_markdown(profile: dict) -> str:
    """A profile (name, totals, languages, modules, patterns, exports) in sections; the first ten exports."""
    out = [f"# Profile: {profile['name']}", "", f"{profile['files']} files, {profile['lines']} lines"]
    if profile.get("languages"):
        out += ["", "## Languages", *(f"- {r['language']}: {r['files']} files ({r['percentage']:.1f}%)" for r in profile["languages"])]
    if profile.get("modules"):
        out += ["", "## Modules", *(f"- {r['module']}: {r['file_count']} files, {r['line_count']} lines" for r in profile["modules"])]
    if profile.get("patterns"):
        out += ["", "## Patterns", *(f"- {r['pattern']} ({r['confidence']:.0%})" for r in profile["patterns"])]
    if profile.get("exports"):
        out += ["", "## Interface", *(f"- `{r['name']}` in {r['file_path']}" for r in profile["exports"][:10])]
    return "\n".join(out)


def comparison_markdown(a: str, b: str, rows: list[dict]) -> str:
    """A table for every dimension: evidence on either side and the trade-off."""
    out = [f"# {a} against {b}"]
    for r in sorted(rows, key=lambda r: r["dimension"]):
        out += ["", f"## {r['dimension'].replace('_', ' ').capitalize()}", "", f"| | {a} | {b} |", "|-|-|-|", f"| evidence | {r['a']} | {r['b']} |", "", r["trade_off"]]
    return "\n".join(out)


FORMATS = {"json": to_json, "xml": to_xml, "markdown": to_markdown}


def render(question: str, chunks: DataFrame, form: str = "markdown") -> str:
    if form not in FORMATS:
        raise ValueError(f"unknown format {form!r}")
    return FORMATS[form](question, chunks)
