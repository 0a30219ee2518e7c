"""Outputs: CSV, JSON, LaTeX, text reports, histories, and copying by plan."""

from __future__ import annotations

import json
import os
import shutil
import subprocess
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows of a LaTeX table, and errors that a report lists.
LATEX_ROWS, REPORT_ERRORS = 80, 50


def write_csv(df: DataFrame, path: str, one_file: bool = True) -> None:
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def to_json(df: DataFrame) -> str:
    """A one-row table as an indented document."""
    row = df.first()
    return json.dumps(row.asDict(True) if row else {}, indent=2, ensure_ascii=False, default=str)


def write_json(what: DataFrame | dict | list, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    text = json.dumps(what, indent=2, ensure_ascii=False, default=str) if isinstance(what, (dict, list)) else to_json(what)
    Path(path).write_text(text, encoding="utf-8")


def _latex_frame(columns: str, caption: str, label: str, head: str, body: list[str]) -> str:
    # The frame of a table.
    top = [r"\begin{table}[t]", r"\centering", rf"\caption{{{caption}}}", rf"\label{{{label}}}", rf"\begin{{tabular}}{{{columns}}}", r"\toprule", head + r" \\", r"\midrule"]
    return "\n".join([*top, *[line + r" \\" for line in body], r"\bottomrule", r"\end{tabular}", r"\end{table}", ""])


def latex_table(df: DataFrame, caption: str, label: str, rows: int = LATEX_ROWS) -> str:
    """At most `rows` rows; underscores become spaces in the header and are escaped in cells."""
    body = [" & ".join("" if v is None else str(v).replace("_", r"\_") for v in r) for r in df.limit(rows).collect()]
    return _latex_frame("l" * len(df.columns), caption, label, " & ".join(c.replace("_", " ") for c in df.columns), body)


def latex_metrics(summary: DataFrame, name: str) -> str:
    """A row of percentages with two decimals."""
    r = summary.first()
    cells = [f"{100 * r[c]:.2f}" for c in ("accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1")]
    return " & ".join([name.replace("_", r"\_"), *cells]) + r" \\" + "\n"


def latex_audit(summary: DataFrame, caption: str = "Split-integrity audit summary.") -> str:
    """A table of findings; pairs of near-duplicates by threshold, the smallest first."""
    r = summary.first()
    # Names of the audits.
    rows = [("Group overlap", r.group_overlap_rows), ("Exact SHA-256 overlap", r.sha256_overlap_rows), ("Filename overlap", r.filename_overlap_rows)]
    rows += [(f"pHash candidates (d <= {t})", n) for t, n in sorted(r.phash_candidate_pairs_by_threshold.items(), key=lambda x: int(x[0]))]
    return _latex_frame("lc", caption, "tab:split_audit", "Audit & Findings", [f"{k} & {v}" for k, v in rows])


def append_history(df: DataFrame, path: str) -> None:
    """Adds rows to a history; the header is written with the first."""
    df.coalesce(1).write.mode("append").option("header", True).csv(path)


def focus_report(overall: DataFrame, by_class: DataFrame, below: DataFrame, lowest: DataFrame, errors: DataFrame, measure: str = "focus") -> str:
    """A text report: distribution, classes, shares below thresholds, lowest values and errors (the first 50)."""
    show = lambda v: f"{v:12.2f}" if isinstance(v, float) else f"{v!s:>12}"
    o = overall.first()
    out = [f"{measure}: {o.n} measured", *[f"  {c:<8}{show(o[c])}" for c in overall.columns if c != "n"], "", "by class"]
    out += ["  " + "".join(f"{c:>12}" for c in by_class.columns)] + ["  " + "".join(show(v) for v in r) for r in by_class.collect()]
    out += ["", "below"] + [f"  {r.threshold:>10.1f}{r.n_below:>10}{r.percent:>9.2f} %" for r in below.collect()]
    out += ["", "lowest"] + ["  " + "  ".join(str(v) for v in r) for r in lowest.collect()]
    listed = errors.limit(REPORT_ERRORS).collect()
    return "\n".join([*out, "", f"errors: {errors.count()}", *["  " + "  ".join(str(v) for v in r) for r in listed], ""])


def exclusion_template(spark: SparkSession, removed=()) -> DataFrame:
    """Rows that a curator fills in: the second round of pictures, and a removal for each (change_id, class_name, folder) of `removed`."""
    # Columns and texts of the template.
    columns = ("change_id", "class_name", "specimen_or_folder", "n_images", "action", "reason")
    round_2 = "quality or metadata mismatch identified during manual QC; fill with final retained/rejected file list if available"
    removal = "folder visually inconsistent with the retained class images; exact file list requires manual QC log"
    rows = [("QC_REIMAGE_ROUND_2", "", "", "", "recollected", round_2)]
    rows += [(change, name, folder, "", "removed", removal) for change, name, folder in removed]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))


def copy_files(plan: DataFrame, root: str, mode: str = "copy", overwrite: bool = False) -> None:
    """Copies or links source_path to root/output_path on the executors; root and sources are on a file system that all of them see.

    A task that is run again writes the same files again."""
    if mode not in ("copy", "symlink"):
        raise ValueError(f"unknown mode: {mode}")
    if overwrite and os.path.isdir(root):
        shutil.rmtree(root)
    os.makedirs(root, exist_ok=True)

    def run(rows) -> None:
        for r in rows:
            target = os.path.join(root, r.output_path)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            if os.path.lexists(target):
                os.remove(target)
            os.symlink(os.path.abspath(r.source_path), target) if mode == "symlink" else shutil.copy2(r.source_path, target)

    plan.where("source_path is not null").select("source_path", "output_path").foreachPartition(run)


def list_outputs(folder: str) -> list[str]:
    return sorted(os.listdir(folder))


def label_map() -> dict[str, str]:
    """Class names by index, as text."""
    from ..schemas import CLASSES

    return {str(i): c for i, c in enumerate(CLASSES)}


def provenance(seed: int | None = None) -> dict:
    """When and from which commit something was made."""
    try:
        commit = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10, check=True).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        commit = None
    return {"created_at": datetime.now(timezone.utc).isoformat(timespec="seconds"), "git_commit": commit, "seed": seed}


def _pyplot():
    try:
        import matplotlib
    except ImportError:
        return None
    matplotlib.use("Agg")
    from matplotlib import pyplot

    return pyplot


def heat_map(confusion: DataFrame, path: str) -> bool:
    """A confusion matrix as a picture; False where matplotlib is missing."""
    if (pyplot := _pyplot()) is None:
        return False
    rows = confusion.collect()  # labels squared
    labels = sorted({r.true_label for r in rows})
    cells = {(r.true_label, r.pred_label): r.n for r in rows}
    fig, ax = pyplot.subplots()
    ax.imshow([[cells[t, p] for p in labels] for t in labels], cmap="Blues")
    for i, t in enumerate(labels):
        for j, p in enumerate(labels):
            ax.text(j, i, cells[t, p], ha="center", va="center")
    ax.set_xticks(range(len(labels)), labels)
    ax.set_yticks(range(len(labels)), labels)
    fig.savefig(path)
    return True


def lines_chart(df: DataFrame, x: str, ys: list[str], path: str) -> bool:
    """Columns of a small table (a history, a histogram) as lines; False where matplotlib is missing."""
    if (pyplot := _pyplot()) is None:
        return False
    rows = df.orderBy(x).collect()
    fig, ax = pyplot.subplots()
    for y in ys:
        ax.plot([r[x] for r in rows], [r[y] for r in rows], label=y)
    ax.legend()
    fig.savefig(path)
    return True


def split_chart(distribution: DataFrame, path: str) -> bool:
    """A grouped bar chart of images by class and split; False where matplotlib is missing."""
    if (pyplot := _pyplot()) is None:
        return False
    from ..operators.audit import SPLITS

    rows = distribution.collect()  # classes times splits
    names = sorted({r.class_name for r in rows})
    fig, ax = pyplot.subplots(figsize=(10, 4))
    for k, s in enumerate(SPLITS):
        values = {r.class_name: r.n_images for r in rows if r.split == s}
        ax.bar([i + 0.27 * (k - 1) for i in range(len(names))], [values.get(n, 0) for n in names], 0.25, label=s)
    ax.set_xticks(range(len(names)), names, rotation=30, ha="right")
    ax.legend()
    fig.tight_layout()
    fig.savefig(path)
    return True
