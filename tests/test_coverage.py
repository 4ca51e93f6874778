"""Every public function of the library is reached by a catalogued query."""

import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1] / "tessera"
LIBRARY = ["functions", "operators", "sources", "streaming", "plans"]


def names(node):
    return {n.attr if isinstance(n, ast.Attribute) else n.id for n in ast.walk(node) if isinstance(n, (ast.Attribute, ast.Name))}


def test_every_function_is_reached_by_a_query():
    bodies, reached, public = {}, set(), {}
    for part in LIBRARY:
        for path in sorted((ROOT / part).glob("*.py")):
            tree = ast.parse(path.read_text())
            if path.name.startswith("catalogue"):
                reached |= names(tree)
                continue
            for f in tree.body:
                if isinstance(f, (ast.FunctionDef, ast.ClassDef)):
                    bodies.setdefault(f.name, set()).update(names(f))
                    if not f.name.startswith("_"):
                        public[f.name] = path.name
    work = [n for n in reached if n in bodies]
    while work:
        for n in bodies.pop(work.pop(), ()):
            if n not in reached and n in bodies:
                reached.add(n)
                work.append(n)
    assert {n: p for n, p in public.items() if n not in reached} == {}
