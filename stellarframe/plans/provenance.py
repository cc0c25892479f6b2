"""Where a result comes from: the environment, and the commit of the checkout that the library runs in."""

from __future__ import annotations

import getpass
import os
import platform
import subprocess
import time


def commit() -> str | None:
    """The commit of the library's own checkout, with + if files have changed; None where it is not run from one."""
    import stellarframe

    root = os.path.dirname(os.path.dirname(os.path.abspath(stellarframe.__file__)))
    if not os.path.exists(os.path.join(root, ".git")) or not os.path.exists(os.path.join(root, "__spark_entry__.py")):
        return None  # installed, or inside of another project's checkout

    def git(*args: str) -> str:
        return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=10, check=True).stdout.strip()

    try:
        return git("rev-parse", "HEAD") + "+" * bool(git("status", "--porcelain", "--untracked-files=no"))
    except (OSError, subprocess.SubprocessError):
        return None


def environment() -> dict[str, str]:
    """Versions, host and time as header cards."""
    import numpy
    import pyspark

    from .. import __version__

    try:
        user = getpass.getuser()
    except (KeyError, OSError):
        user = "unknown"
    cards = {"VERSION": __version__, "SPARK": pyspark.__version__, "NUMPY": numpy.__version__, "PYTHON": platform.python_version(), "HOST": platform.node(), "USER": user, "CREATED": time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime())}
    here = commit()
    return cards | ({"COMMIT": here} if here else {})
