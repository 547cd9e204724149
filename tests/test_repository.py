"""Versions from a repository against what its own tool says."""

import os
import random
import shutil
import subprocess

import pytest

from clauseloom.sources import repository as R

pytestmark = pytest.mark.skipif(shutil.which("git") is None, reason="git makes the repository")


class Repository:
    def __init__(self, folder):
        self.folder, self.clock = str(folder), 1_600_000_000
        os.makedirs(self.folder)
        self("init", "-q", "-b", "main")

    def __call__(self, *args, zone="+0900"):
        self.clock += 86_000
        who = {f"GIT_{w}_{k}": v for w in ("AUTHOR", "COMMITTER") for k, v in (("NAME", "n"), ("EMAIL", "e@x"), ("DATE", f"{self.clock} {zone}"))}
        return subprocess.run(["git", "-C", self.folder, *args], capture_output=True, check=True, env=os.environ | who | {"GIT_CONFIG_GLOBAL": "/dev/null"}).stdout.decode()

    def put(self, path, text, zone="+0900"):
        where = os.path.join(self.folder, path)
        os.makedirs(os.path.dirname(where), exist_ok=True)
        with open(where, "w") as f:
            f.write(text)
        self("add", "-A")
        self("commit", "-qm", path, zone=zone)

    def versions(self, path):
        """As log and show give them; deletions left out."""
        out = []
        for line in self("log", "--reverse", "--format=%H%x09%ad", "--date=short", "--", path).splitlines():
            commit, day = line.split("\t")
            if subprocess.run(["git", "-C", self.folder, "cat-file", "-e", f"{commit}:{path}"], capture_output=True).returncode == 0:
                out.append((commit, day, self("show", f"{commit}:{path}")))
        return out


@pytest.fixture(params=["loose", "packed"])
def repository(request, tmp_path):
    repo, rng = Repository(tmp_path / "repo"), random.Random(2)
    long = [f"제{n}조 조항 {rng.random()}" for n in range(300)]
    for n in range(14):
        long[rng.randrange(300)] = f"revised {n} {rng.random()}"
        repo.put("acme/shop/terms.md", "---\ntitle: Terms\n---\n\n" + "\n".join(long), zone=rng.choice(["+0900", "-0800", "+0000"]))
        if n % 3 == 0:
            repo.put(f"acme/privacy{n % 2}.md", f"text {n}\n" * (n + 1))
        if n == 7 and request.param == "packed":
            repo("gc", "-q")
    repo.put("acme/README.md", "no document")
    repo.put("acme/notes.txt", "no markdown")
    repo("rm", "-q", "acme/privacy1.md"), repo("commit", "-qm", "gone")
    repo("checkout", "-qb", "side"), repo.put("beta/a.md", "side one"), repo("checkout", "-q", "main")
    repo.put("beta/b.md", "main one"), repo("merge", "-q", "--no-ff", "-m", "both", "side")
    repo.put("beta/a.md", "side two")
    if request.param == "packed":
        repo("repack", "-adfq", "--depth=50")
        repo("pack-refs", "--all")
    repo.put("acme/shop/terms.md", "---\ntitle: Terms\n---\nlast")
    return repo


def test_versions_are_those_of_the_log(spark, repository):
    found = {}
    for r in R.read_repository(spark, repository.folder, current=False).collect():
        found.setdefault(r.path, []).append(r)
    paths = ["acme/shop/terms.md", "acme/privacy0.md", "acme/privacy1.md", "beta/a.md", "beta/b.md"]
    assert sorted(found) == sorted(paths)
    for path in paths:
        own = sorted(found[path], key=lambda r: r.version_seq)
        want = repository.versions(path)
        assert [r.version_seq for r in own] == list(range(1, len(want) + 1))
        assert [(r.commit, str(r.version_date)) for r in own] == [w[:2] for w in want]
        assert all(w[2].endswith(r.body) and r.body for r, w in zip(own, want))
    assert {r.meta["title"] for r in found["acme/shop/terms.md"]} == {"Terms"}
    assert "acme/privacy1.md" not in {r.path for r in R.read_repository(spark, repository.folder).select("path").distinct().collect()}


def test_partitions_refs_and_empty_repositories(spark, repository, tmp_path, monkeypatch):
    whole = sorted(map(tuple, R.read_repository(spark, repository.folder).drop("meta").collect()))
    monkeypatch.setattr(R, "COMMITS", 3)
    reader = R.RepositoryReader(repository.folder, "HEAD", ".md")
    parts = reader.partitions()
    assert len(parts) > 5 and sum(len(list(reader.read(p))) for p in parts) >= len(whole)
    assert {r.path for r in R.read_repository(spark, repository.folder, "side").collect()} == {"acme/shop/terms.md", "acme/privacy0.md", "beta/a.md"}
    assert R.read_repository(spark, Repository(tmp_path / "new").folder).count() == 0
    with pytest.raises(KeyError):
        R.Objects(repository.folder).read("0" * 40)
