"""A script, or a notebook, that repeats an analysis through the public API."""

from __future__ import annotations

import json
from dataclasses import fields

from lathe.options import Options

_CUT = "# ---- "


def script(options: Options, train: str, validation: str | None = None, test: str | None = None) -> str:
    """Python source. Options that have their defaults aren't spelled out."""
    given = [f"    {f.name}={getattr(options, f.name)!r}," for f in fields(options) if f.name not in ("progress", "models") and getattr(options, f.name) != f.default]
    files = ", ".join(repr(x) for x in (train, validation, test) if x is not None) if test is None or validation is not None else f"{train!r}, test={test!r}"
    parts = [
        ("Session", "from lathe import Options, analyze, read_dataset\nfrom lathe.operators import audit\nfrom lathe.plans import reports\nfrom lathe.plans.analysis import save_model\nfrom lathe.session import get_session\n\nspark = get_session()"),
        ("Data", f"data = read_dataset(spark, {files})"),
        ("Options", "options = Options(\n" + "\n".join(given) + "\n)"),
        ("Analysis", "result = analyze(data, options)"),
        ("Profile", "print(reports.profile_report(result.profile))"),
        ("Preparation", "print(reports.preparation_report(result.prepared))"),
        ("Models", "print(reports.training_report(result))\nprint(reports.best_report(result))\nresult.metrics.show(truncate=False)"),
        ("Audit", "print(audit.report(spark, result.findings))"),
        ("Charts", 'for name, data in (result.comparison_charts() | result.model_charts()).items():\n    data.coalesce(1).write.mode("overwrite").json(f"charts/{name}")'),
        ("Model", 'try:\n    save_model(result, "best_model")\nexcept ValueError as e:\n    print(e)'),
    ]
    return "\n\n".join(f"{_CUT}{title}\n{code}" for title, code in parts) + "\n"


def notebook(source: str) -> str:
    """A script of `script` as notebook JSON: a heading and a code cell for each part."""
    cells = []
    for k, part in enumerate(x for x in source.split(_CUT) if x.strip()):
        title, _, code = part.partition("\n")
        cells.append({"cell_type": "markdown", "id": f"title-{k}", "metadata": {}, "source": [f"## {title.strip()}"]})
        cells.append({"cell_type": "code", "id": f"code-{k}", "metadata": {}, "execution_count": None, "outputs": [], "source": code.strip().splitlines(keepends=True)})
    about = {"kernelspec": {"display_name": "Python 3", "language": "python", "name": "python3"}, "language_info": {"name": "python"}}
    return json.dumps({"cells": cells, "metadata": about, "nbformat": 4, "nbformat_minor": 5}, indent=1)


def write(path: str, text: str) -> str:
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path
