"""The build's identity: packaged, from a checkout, from packed references, or unknown."""

from lodestone import __version__, build

HASH = "0123456789abcdef0123456789abcdef01234567"


def test_revision_of_a_package_or_a_checkout(tmp_path, monkeypatch):
    package = tmp_path / "tree" / "lodestone"
    git = tmp_path / "tree" / ".git"
    package.mkdir(parents=True)
    assert build.revision(package) == ""
    (git / "refs" / "heads").mkdir(parents=True)
    (git / "HEAD").write_text("ref: refs/heads/main\n")
    assert build.revision(package) == ""
    (git / "packed-refs").write_text(f"# pack-refs with: peeled\n{HASH} refs/heads/main\n^{HASH[::-1]}\n")
    assert build.revision(package) == HASH
    (git / "refs" / "heads" / "main").write_text("f" * 40 + "\n")
    assert build.revision(package) == "f" * 40
    (git / "HEAD").write_text(HASH)
    assert build.revision(package) == HASH
    linked = tmp_path / "linked" / "lodestone"
    linked.mkdir(parents=True)
    (git / "worktrees" / "w").mkdir(parents=True)
    (git / "worktrees" / "w" / "HEAD").write_text("ref: refs/heads/main")
    (git / "worktrees" / "w" / "commondir").write_text("../..")
    (linked.parent / ".git").write_text(f"gitdir: {git}/worktrees/w\n")
    assert build.revision(linked) == "f" * 40
    (package / build.REVISION_FILE).write_text("packaged\n")
    assert build.revision(package) == "packaged"
    monkeypatch.setattr(build, "revision", lambda: HASH)
    assert build.identity().startswith(f"{__version__} ({HASH[:12]}) ") and "/" in build.identity()
    monkeypatch.setattr(build, "revision", lambda: "")
    assert "(" not in build.identity()
