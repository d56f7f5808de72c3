"""JSON and Markdown from tables of bounded size: summaries, never data."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame


def rows_of(df: DataFrame, most: int = 10_000) -> list[dict]:
    rows = [r.asDict(recursive=True) for r in df.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"a report table has more than {most} rows")
    return rows


def write_json(path: str | Path, document: dict) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(document, indent=2, default=str) + "\n", encoding="utf-8")


def markdown_table(rows: list[dict], columns: list[str] | None = None) -> str:
    columns = columns or (list(rows[0]) if rows else [])
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows)])


def markdown_report(title: str, sections: dict[str, DataFrame | str]) -> str:
    out = [f"# {title}"]
    for name, what in sections.items():
        out += [f"## {name}", what if isinstance(what, str) else markdown_table(rows_of(what), what.columns)]
    return "\n\n".join(out) + "\n"


#: The sections of an audit's report, in their order.
SECTIONS = ["Dataset", "Dataset structure", "Total images", "Class distribution", "Train/Test distribution", "File formats", "Image dimensions", "Image modes/channels", "Corrupt files", "Exact duplicates",
            "Cross-split duplicates", "Perceptual near-duplicates (heuristic)", "Potential leakage concerns", "Observations", "Decision required before Phase 3"]


def _facts(facts: dict) -> str:
    return "\n".join(f"- {k}: {v}" for k, v in facts.items())


def audit_report(d: dict) -> str:
    """An audit's summary document as Markdown, a section each of SECTIONS."""
    c, dup, near, size, corrupt = d["counts"], d["duplicates"], d["perceptual_duplicates"], d["dimensions"], d["corrupt_images"]
    share = lambda n, of: f"{n / of * 100:.2f} %" if of else "0.00 %"
    table = lambda pairs, a, b: markdown_table([{a: k, b: v} for k, v in pairs.items()], [a, b]) if pairs else "None."
    issues = {k: v for k, v in d["structure_issues"].items() if v and k != "counts"}
    cross, clash = dup["groups_crossing_splits"], dup["conflicting_class_groups"]
    concerns = [x for x, n in ((f"{cross} content(s) occur in more than one split.", cross), (f"{clash} content(s) carry different class labels.", clash), (f"{near.get('cross_split_groups')} near-duplicate group(s) span splits.", near.get("cross_split_groups"))) if n]
    decisions = [x for x, n in (("Keep or remove copies that cross splits.", cross), ("Choose a label for contents with conflicting classes.", clash), ("Remove or repair corrupt files.", corrupt["count"])) if n]
    text = {
        "Dataset": _facts({k: ", ".join(v) if isinstance(v, list) else v for k, v in d["dataset"].items()} | {"audited at": d["generated_at_utc"]}),
        "Dataset structure": _facts({k: json.dumps(v, ensure_ascii=False) for k, v in issues.items()}) or "As expected.",
        "Total images": _facts({"files scanned": c["total_files_scanned"], "images": c["total_images"], "valid": c["valid_images"], "invalid": c["invalid_images"], "other files": c["non_image_files"], "MB": c["total_size_mb"]}),
        "Class distribution": markdown_table([{"class": k, "images": n, "valid": c["valid_per_class"][k], "share": share(n, c["total_images"])} for k, n in c["per_class"].items()]),
        "Train/Test distribution": markdown_table([{"split": s, **cells, "all": c["per_split"][s], "share": share(c["per_split"][s], c["total_images"])} for s, cells in c["per_split_class"].items()]),
        "File formats": table(d["extensions"]["image_extensions"], "extension", "files") + "\n\n" + _facts({"formats that differ from the extension": d["format_extension_mismatches"]["count"]}),
        "Image dimensions": _facts({"different sizes": size["unique_combinations"], "width": f"{size['min_width']} to {size['max_width']}", "height": f"{size['min_height']} to {size['max_height']}"}) + "\n\n" + markdown_table(size["most_common"], ["width", "height", "count", "percentage"]),
        "Image modes/channels": table(d["modes"]["counts_by_mode"], "mode", "images"),
        "Corrupt files": _facts({"corrupt": corrupt["count"], **corrupt["by_split"]}) + ("\n\n" + markdown_table(corrupt["examples"]) if corrupt["examples"] else ""),
        "Exact duplicates": _facts({"groups": dup["groups_total"], "files in them": dup["files_in_duplicate_groups"], "percent of valid images": dup["duplicate_file_ratio_percent"], **{f"groups within {k}": v for k, v in dup["groups_within_splits"].items()}}),
        "Cross-split duplicates": _facts({"groups": cross, "Training files": dup["cross_split_files_training"], "Testing files": dup["cross_split_files_testing"]}),
        "Perceptual near-duplicates (heuristic)": _facts({k.replace("_", " "): v for k, v in near.items() if v is not None}),
        "Potential leakage concerns": "\n".join(f"- {x}" for x in concerns) or "None found.",
        "Observations": "\n".join(f"- {x}" for x in d["warnings"]) or "None.",
        "Decision required before Phase 3": "\n".join(f"- {x}" for x in decisions) or "None."}
    return markdown_report("Dataset audit", {k: text[k] for k in SECTIONS})
