"""An external language server for modules: found, started on copies of a few files, its report read. Optional; runs on the
driver for the files of one request, never on executors."""

from __future__ import annotations

import os
import re
import shutil
import subprocess
import tempfile
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

#: Names of the program (fixed values) and the settings that name it, its configuration and its time limit.
PROGRAMS = ("bsl-language-server", "bsl_ls")
BINARY, CONFIG, TIMEOUT = "BSL_LS_BINARY", "BSL_LS_CONFIG", "BSL_LS_TIMEOUT"


@dataclass
class Analysis:
    """status: unavailable, not_run, timeout, failed or completed; report: JSON as report_diagnostics reads it, paths as given."""

    status: str
    detail: str = ""
    report: str = ""
    files: list[str] = field(default_factory=list)


def find_server(settings: Mapping[str, str] | None = None) -> str | None:
    s = os.environ if settings is None else settings
    named = s.get(BINARY, "").strip()
    if named:
        return named if os.access(named, os.X_OK) else shutil.which(named)
    return next((p for n in PROGRAMS if (p := shutil.which(n))), None)


def server_status(settings: Mapping[str, str] | None = None) -> dict:
    """V9."""
    s = os.environ if settings is None else settings
    found = find_server(s)
    conf = s.get(CONFIG, "").strip()
    return {"available": found is not None, "binary": found or "", "configuration": conf, "configuration_found": bool(conf) and os.path.exists(conf), "timeout": time_limit(s), "status": "not_run" if found else "unavailable"}


def time_limit(settings: Mapping[str, str]) -> int:
    text = settings.get(TIMEOUT, "").strip()
    return max(1, int(text)) if re.fullmatch(r"\d+", text) else 60


def analyze(modules: Mapping[str, bytes], settings: Mapping[str, str] | None = None) -> Analysis:
    """V2: runs the server over copies of the given modules (path to content) in a folder of its own that is removed
    afterwards. The copies' paths in the report become the given ones."""
    s = os.environ if settings is None else settings
    program = find_server(s)
    if program is None:
        return Analysis("unavailable", "no language server was found")
    if not modules:
        return Analysis("not_run", "no files")
    with tempfile.TemporaryDirectory(prefix="modules-") as folder:
        source, out = Path(folder, "src"), Path(folder, "out")
        source.mkdir()
        out.mkdir()
        names = {}
        for i, (path, content) in enumerate(modules.items()):
            copy = source / f"{i:05d}.bsl"
            copy.write_bytes(content)
            names[str(copy)] = path
        command = [program, "analyze", "--srcDir", str(source), "--outputDir", str(out), "--reporter", "json"]
        if (conf := s.get(CONFIG, "").strip()) and os.path.exists(conf):
            command += ["--configuration", conf]
        try:
            run = subprocess.run(command, capture_output=True, timeout=time_limit(s))
        except subprocess.TimeoutExpired:
            return Analysis("timeout", f"no answer in {time_limit(s)} s", files=list(modules))
        except OSError as e:
            return Analysis("failed", str(e), files=list(modules))
        reports = sorted(out.glob("*.json"))
        if not reports:
            return Analysis("failed", run.stderr.decode("utf-8", "replace")[-500:], files=list(modules))
        text = reports[0].read_text(encoding="utf-8")
        for copy, path in names.items():
            for written in (Path(copy).as_uri(), copy):
                text = text.replace(written, path.replace("\\", "/"))
        return Analysis("completed", "", text, list(modules))
