"""A report of a dataset: key figures, health, findings and advice, as sections and as Markdown."""

from __future__ import annotations

import re
from html import escape

from siltstone.functions.stats import compact
from siltstone.operators import charts, insights, kpi
from siltstone.plans.recipe import Dataset


def build(ds: Dataset) -> list[tuple[str, list[str]]]:
    """Ten sections (title, lines) in order; each has a line at least."""
    p = ds.profile()
    s = kpi.read(p, ds.df)
    context = insights.Context(ds.df, p, s, ds.truncated)
    found = insights.analyze(context)
    figures = kpi.kpis(ds.df, p, s)
    panels = charts.dashboard(ds.df, p, s)
    of = lambda *kinds: [f for f in found if f.kind in kinds]
    dated = next((c for c in p.columns if c.date_min), None)
    advice = insights.recommendations(found)
    urgent = sum(f.severity == "critical" for f in found)
    overview = [f"{ds.name}: {p.rows} rows, {len(p.columns)} columns."]
    overview += [f"From {dated.date_min[:10]} to {dated.date_max[:10]} by {dated.name}."] if dated else []
    overview += ["The file was read in part."] if ds.truncated else []
    overview += [f"{len(ds.ops)} cleaning steps were taken: " + "; ".join(" ".join(map(str, op[:2])) for op in ds.ops) + "."] if ds.ops else []
    overview += [f"{c.name}: {c.type}, filled to {c.completeness:g} %, {c.unique} distinct, {c.missing} missing" for c in p.columns]
    causes = [f"{f.columns[0]}: {f.figures['where'][1]:.0f} % of the extreme values have {context.dimension} = {f.figures['where'][0]}." for f in of("outlier") if f.figures.get("where")]
    causes += [f"{f.text} {insights.advice(f)}" for f in of("change", "target") if f.severity != "positive"]
    sections = [
        ("Summary", [insights.summary(context, ds.name, found), *(f"{f.severity}: {f.text}" for f in found[:3])]),
        ("Overview", overview),
        ("Data quality", [f"{k}: {v}" for k, v in p.health.items()] + [d.message for d in p.diagnostics if not d.skipped]),
        ("Key figures", [f"{k.label}: {compact(k.value)}" + (f" ({k.delta:+.1f} %)" if k.delta is not None else "") for k in figures]),
        ("Trends", [f.text for f in of("trend", "change")]),
        ("Charts", [f"{c.type} of {c.y or 'rows'} by {c.x}" + (f" and {c.series}" if c.series else "") for c in panels]),
        ("Findings", [f"{f.severity}: {f.text}" for f in found]),
        ("Causes", causes),
        ("Advice", [f"{k}. {a}" for k, a in enumerate(advice, 1)]),
        ("Conclusion", [f"{len(found)} findings, {urgent} of them critical; health is {p.health['overall']} %." + (f" First: {advice[0]}" if advice else "")]),
    ]
    return [(t, lines or ["None."]) for t, lines in sections]


def markdown(sections: list[tuple[str, list[str]]], without: frozenset[str] = frozenset()) -> str:
    parts = [f"## {t}\n\n" + "\n".join("- " + line.replace("|", "\\|") for line in lines) for t, lines in sections if t not in without]
    return "\n\n".join(parts) + "\n"


def html(sections: list[tuple[str, list[str]]], title: str, without: frozenset[str] = frozenset()) -> str:
    """A page of its own, with all text escaped."""
    parts = [f"<h2>{escape(t)}</h2><ul>" + "".join(f"<li>{escape(line)}</li>" for line in lines) + "</ul>" for t, lines in sections if t not in without]
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>' + "".join(parts) + "</body></html>"


def text(sections: list[tuple[str, list[str]]], without: frozenset[str] = frozenset()) -> str:
    return "\n\n".join(t.upper() + "\n" + "\n".join("  " + line for line in lines) for t, lines in sections if t not in without) + "\n"


#: Writers by the name of a format, with what each keeps and leaves out.
FORMATS = {
    "md": (markdown, "titles and lines", "charts"),
    "html": (lambda sections: html(sections, sections[0][0] if sections else "Report"), "titles and lines", "charts"),
    "txt": (text, "lines", "charts and emphasis"),
}


def file_name(dataset: str, kind: str) -> str:
    """A name that any file system takes: letters, digits and hyphens."""
    return (re.sub(r"[^\w]+", "-", dataset.rsplit(".", 1)[0].lower()).strip("-") or "report") + f".{kind}"
