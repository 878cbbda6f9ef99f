"""Which build is running: version, revision and platform."""

import platform
from pathlib import Path

from . import __version__

REVISION_FILE = "_revision.txt"  # a packager writes the revision here
SHOWN = 12


def revision(package: Path = Path(__file__).resolve().parent) -> str:
    """The packaged revision, else that of the checkout the package lies in, else ''."""
    packaged = _text(package / REVISION_FILE)
    if packaged:
        return packaged
    git = package.parent / ".git"
    if git.is_file():  # a worktree: the file names its folder
        git = (git.parent / _text(git).removeprefix("gitdir:").strip()).resolve()
    head = _text(git / "HEAD")
    if not head.startswith("ref:"):
        return head
    ref = head.removeprefix("ref:").strip()
    common = git / (_text(git / "commondir") or ".")
    packed = dict(reversed(line.split(" ", 1)) for line in _text(common / "packed-refs").splitlines()
                  if " " in line and line[0] not in "#^")
    return _text(git / ref) or _text(common / ref) or packed.get(ref, "")


def identity() -> str:
    """`0.1.0 (revision) system/machine`; the revision only where it is known."""
    known = revision()[:SHOWN]
    return " ".join(filter(None, (__version__, f"({known})" if known else "",
                                  f"{platform.system().lower()}/{platform.machine().lower()}")))


def _text(path: Path) -> str:
    try:
        return path.read_text().strip()
    except OSError:
        return ""
