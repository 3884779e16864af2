"""Rendering of small, already selected results as text on the driver."""

from __future__ import annotations

from pyspark.sql import Row

from tesserae import constants as C

START, END = "<!-- MEMORY_START -->", "<!-- MEMORY_END -->"


def title(category: str) -> str:
    return " ".join(w[:1].upper() + w[1:] for w in category.split("_"))


def cut_to(text: str, tokens: int) -> str:
    """The text in about ``tokens`` tokens, cut at a line end if there is one."""
    if len(text) <= 4 * tokens:
        return text
    head = text[: 4 * tokens]
    at = head.rfind("\n")
    return (head[:at] if at > 0 else head) + "\n\n*[cut to the token budget]*"


def entity_section(profiles: list[Row], most: int = C.MAX_ENTITIES) -> str:
    """One line per entity profile (name, entity_type, facts)."""
    lines = [f"- **{p.name}** ({p.entity_type}): {'; '.join(p.facts[: C.MAX_FACTS])}" for p in profiles[:most] if p.facts]
    return "\n".join(["## Entities", "", *lines, ""]) if lines else ""


def render(selected: list[Row], branch: str, profiles: list[Row] = (), stale_hours: float | None = None) -> str:
    """Selected memories (memory_type, summary[, tags]) by category in order of appearance, under the branch, cut to the render limit where a tenth beyond it; empty without memories."""
    if not selected:
        return ""
    parts = [f"# Memory: {branch}", ""]
    if stale_hours is not None:
        parts += [f"> {stale_hours:.1f} hours old", ""]
    if section := entity_section(list(profiles)):
        parts.append(section)
    for category in dict.fromkeys(r.memory_type for r in selected):
        parts += [f"## {title(category)}", ""]
        for r in selected:
            if r.memory_type == category:
                tags = [t for t in ("tags" in r and r.tags or []) if t]
                parts += [f"- {r.summary}", *([f"  *Tags: {', '.join(tags)}*"] if tags else [])]
        parts.append("")
    text = "\n".join(parts).rstrip()
    return wrap(cut_to(text, C.RENDER_MAX) if len(text) > 4.4 * C.RENDER_MAX else text)


def wrap(text: str) -> str:
    return f"{START}\n{text}\n{END}" if text.strip() else ""
