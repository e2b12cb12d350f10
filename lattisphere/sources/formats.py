"""Parsers of structure and trajectory files: text to frames. A frame is (lattice of nine numbers, energy, symbols, positions)."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np

from ..functions.elements import BOHR
from ..functions.geometry import lattice_from_parameters

MOST_ATOMS = 100_000_000


@dataclass
class Frame:
    lattice: list[float]
    symbols: list[str] = field(default_factory=list)
    positions: list[list[float]] = field(default_factory=list)
    energy: float = 0.0

    def placed(self, fractional: bool, wrap: bool = False) -> Frame:
        """Positions as Cartesian, from fractions if so, inside the cell if asked."""
        cell = np.array(self.lattice, float).reshape(3, 3)
        p = np.array(self.positions, float).reshape(-1, 3)
        if fractional:
            p = (p - np.floor(p)) @ cell if wrap else p @ cell
        elif wrap:
            f = p @ np.linalg.inv(cell)
            p = (f - np.floor(f)) @ cell
        self.positions = p.tolist()
        return self


PARSERS: dict[str, tuple] = {}


def parser(name: str, *extensions: str, trajectory: bool = False):
    def keep(function):
        PARSERS[name] = (function, extensions, trajectory)
        return function

    return keep


def _numbers(line: str, n: int | None = None) -> list[float]:
    out = []
    for t in line.split():
        try:
            out.append(float(t.replace("D", "E").replace("d", "e")))
        except ValueError:
            break
    return out if n is None else out[:n]


def _poscar_header(lines: list[str]):
    scale = float(lines[1].split()[0])
    cell = np.array([_numbers(x, 3) for x in lines[2:5]])
    if scale < 0:
        scale = (-scale / abs(np.linalg.det(cell))) ** (1 / 3)
    words = lines[5].split()
    if words and re.fullmatch(r"[+-]?\d+", words[0]):
        counts, at = [int(w) for w in words if re.fullmatch(r"[+-]?\d+", w)], 6
        kinds = [f"Type{k + 1}" for k in range(len(counts))]
    else:
        kinds, counts, at = words, [int(w) for w in lines[6].split() if re.fullmatch(r"[+-]?\d+", w)], 7
    if any(c < 0 for c in counts) or sum(counts) > MOST_ATOMS:
        raise ValueError("impossible number of atoms")
    return (cell * scale).ravel().tolist(), [k for k, c in zip(kinds, counts, strict=False) for _ in range(c)], at


@parser("vasp", "poscar", "contcar", "vasp")
def vasp(text: str) -> list[Frame]:
    lines = text.splitlines()
    cell, symbols, at = _poscar_header(lines)
    if lines[at].strip()[:1].lower() == "s":
        at += 1
    direct = lines[at].strip()[:1].lower() == "d"
    rows = [_numbers(x, 3) for x in lines[at + 1 : at + 1 + len(symbols)]]
    return [Frame(cell, symbols, rows).placed(direct, wrap=True)]


@parser("xdatcar", "xdatcar", trajectory=True)
def xdatcar(text: str) -> list[Frame]:
    lines = text.splitlines()
    cell, symbols, at = _poscar_header(lines)
    starts = [k for k in range(at, len(lines)) if lines[k].strip().lower().startswith("direct")]
    return [Frame(list(cell), list(symbols), [_numbers(x, 3) for x in lines[k + 1 : k + 1 + len(symbols)]]).placed(True, wrap=True) for k in starts]


@parser("lammps", "dump", "lammpstrj", trajectory=True)
def lammps(text: str) -> list[Frame]:
    return [lammps_frame(x) for x in re.split(r"(?m)^ITEM: TIMESTEP[^\n]*\n", text)[1:]]


def lammps_frame(text: str) -> Frame:
    """One frame, from the line after its ITEM: TIMESTEP on. The box loses its origin; rows that do not parse are left out."""
    lines = text.splitlines()
    cell, symbols, rows, k, scaled = [0.0] * 9, [], [], 0, False
    while k < len(lines):
        line = lines[k]
        k += 1
        if line.startswith("ITEM: BOX BOUNDS"):
            box = [_numbers(x) for x in lines[k : k + 3]]
            k += 3
            low, high = [b[0] for b in box], [b[1] for b in box]
            xy, xz, yz = (b[2] for b in box) if "xy" in line else (0.0, 0.0, 0.0)
            if "xy" in line:  # the bounds of a tilted box hold its tilt
                low[0] -= min(0.0, xy, xz, xy + xz)
                high[0] -= max(0.0, xy, xz, xy + xz)
                low[1] -= min(0.0, yz)
                high[1] -= max(0.0, yz)
            side = [h - w for h, w in zip(high, low, strict=True)]
            cell = [side[0], 0.0, 0.0, xy, side[1], 0.0, xz, yz, side[2]]
        elif line.startswith("ITEM: ATOMS"):
            names = line.split()[2:]
            scaled = any(n in names for n in ("xs", "xsu"))
            at = [next((names.index(n) for n in (f"{c}s", f"{c}su") if n in names), None) if scaled else next((names.index(n) for n in (c, f"{c}u") if n in names), None) for c in "xyz"]
            kind = next((names.index(n) for n in ("element", "type", "id") if n in names), None)
            while k < len(lines) and not lines[k].startswith("ITEM:"):
                words = lines[k].split()
                k += 1
                try:
                    rows.append([float(words[c]) for c in at])
                    symbols.append(words[kind] if kind is not None else "X")
                except (IndexError, ValueError, TypeError):
                    continue
    return Frame(cell, symbols, rows).placed(scaled)


@parser("gromacs", "gro", trajectory=True)
def gromacs(text: str) -> list[Frame]:
    lines, k, out = text.splitlines(), 0, []
    while k + 2 < len(lines):
        try:
            n = int(lines[k + 1].split()[0])
        except (ValueError, IndexError):
            break
        frame = Frame([0.0] * 9)
        for line in lines[k + 2 : k + 2 + n]:
            if len(line) < 44:
                continue
            name = re.sub(r"\d", "", line[10:15].strip())
            frame.symbols.append({"OW": "O", "HW": "H"}.get(name, name))
            frame.positions.append([10 * float(line[a : a + 8]) for a in (20, 28, 36)])
        box = _numbers(lines[k + 2 + n]) if k + 2 + n < len(lines) else []
        if len(box) >= 3:
            frame.lattice = [10 * box[0], 0.0, 0.0, 0.0, 10 * box[1], 0.0, 0.0, 0.0, 10 * box[2]]
        out.append(frame)
        k += n + 3
    return out


@parser("pdb", "pdb", "ent", trajectory=True)
def pdb(text: str) -> list[Frame]:
    cell, out, frame = [0.0] * 9, [], None
    for line in text.splitlines():
        tag = line[:6].strip()
        if tag == "CRYST1":
            a, b, c = (float(line[x : x + 9]) for x in (6, 15, 24))
            cell = [a, 0.0, 0.0, 0.0, b, 0.0, 0.0, 0.0, c]
        elif tag == "MODEL":
            frame = Frame(list(cell))
        elif tag in ("ATOM", "HETATM"):
            frame = frame or Frame(list(cell))
            symbol = line[76:78].strip() or re.match(r"\d*([A-Za-z]*)", line[12:16].strip())[1]
            frame.symbols.append(symbol[:1].upper() + symbol[1:].lower() if len(symbol) <= 2 else symbol)
            frame.positions.append([float(line[x : x + 8]) for x in (30, 38, 46)])
        elif tag == "ENDMDL" and frame:
            out.append(frame)
            frame = None
    return out + [frame] * bool(frame and frame.symbols)


@parser("espresso", "pwi", "pwo", "in", trajectory=True)
def espresso(text: str) -> list[Frame]:
    lines, cell, out, k = text.splitlines(), [0.0] * 9, [], 0
    while k < len(lines):
        line = lines[k].strip()
        k += 1
        if line.startswith("CELL_PARAMETERS"):
            cell = [v for x in lines[k : k + 3] for v in _numbers(x, 3)]
            k += 3
        elif line.startswith("ATOMIC_POSITIONS"):
            frame = Frame(list(cell))
            while k < len(lines) and len(w := lines[k].split()) >= 4 and len(v := _numbers(" ".join(w[1:4]))) == 3:
                frame.symbols.append(w[0])
                frame.positions.append(v)
                k += 1
            out.append(frame)
    return out


@parser("cp2k", "inp", "restart", "cp2k", trajectory=True)
def cp2k(text: str) -> list[Frame]:
    cell, out, frame, inside = [0.0] * 9, [], None, None
    for raw in text.splitlines():
        words = raw.split()
        if not words:
            continue
        tag = words[0].upper()
        if tag == "&CELL":
            inside = "cell"
        elif tag == "&COORD":
            if frame and frame.symbols:
                out.append(frame)
            frame, inside = Frame(list(cell)), "coord"
        elif tag.startswith("&END"):
            inside = None
        elif inside == "cell" and tag == "ABC":
            v = [float(w) for w in words[1:] if re.match(r"[-+.\d]", w)][-3:]
            cell = [v[0], 0.0, 0.0, 0.0, v[1], 0.0, 0.0, 0.0, v[2]]
            if frame:
                frame.lattice = list(cell)
        elif inside == "coord" and len(v := _numbers(" ".join(words[1:4]))) == 3:
            frame.symbols.append(words[0])
            frame.positions.append(v)
    for f in [*out, frame]:
        if f and not any(f.lattice):
            f.lattice = list(cell)
    return out + [frame] * bool(frame and frame.symbols)


@parser("xyz", "xyz", "exyz", trajectory=True)
def xyz(text: str) -> list[Frame]:
    lines, k, out = text.splitlines(), 0, []
    while k < len(lines):
        if not lines[k].strip():
            k += 1
            continue
        n = int(lines[k].split()[0])
        comment = lines[k + 1] if k + 1 < len(lines) else ""
        lattice = re.search(r'Lattice\s*=\s*"([^"]*)"', comment, re.I)
        energy = re.search(r"(?:^|\s)(?:dft_energy|energy|Energy)\s*=\s*\"?([-+.\deE]+)", comment)
        kind, pos = 0, 1
        if found := re.search(r"Properties\s*=\s*\"?([^\s\"]+)", comment):
            at, parts = 0, found[1].split(":")
            for name, _, width in zip(parts[::3], parts[1::3], parts[2::3], strict=False):
                kind, pos = (at if name in ("species", "type") else kind), (at if name == "pos" else pos)
                at += int(width)
        frame = Frame(_numbers(lattice[1], 9) if lattice else [0.0] * 9, energy=float(energy[1]) if energy else 0.0)
        for line in lines[k + 2 : k + 2 + n]:
            words = line.split()
            frame.symbols.append(words[kind])
            frame.positions.append([float(w) for w in words[pos : pos + 3]])
        out.append(frame)
        k += n + 2
    return out


def symmetry_operation(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Rotation and shift of an operation such as `-x, y+1/2, z`."""
    turn, shift = np.zeros((3, 3)), np.zeros(3)
    for row, part in enumerate(text.strip().strip("'\"").lower().split(",")):
        for sign, term in re.findall(r"([+-]?)\s*([\d./]*\*?[xyz]|[\d./]+)", part):
            s = -1.0 if sign == "-" else 1.0
            if term[-1] in "xyz":
                turn[row, "xyz".index(term[-1])] += s * (float(term[:-1].rstrip("*") or 1))
            else:
                a, _, b = term.partition("/")
                shift[row] += s * float(a) / float(b or 1)
    return turn, shift


def _cif_tokens(text: str) -> list[str]:
    return [a or b or c for line in text.splitlines() for a, b, c in re.findall(r"'([^']*)'|\"([^\"]*)\"|([^\s#'\"]\S*)", line.split(" #")[0] if not line.startswith("#") else "")]


def _clean(value: str) -> float:
    return float(re.sub(r"\(\d*\)", "", value))


@parser("cif", "cif")
def cif(text: str) -> list[Frame]:
    tokens, single, loops, k = _cif_tokens(text), {}, [], 0
    while k < len(tokens):
        t = tokens[k]
        k += 1
        if t.lower() == "loop_":
            names, rows = [], []
            while k < len(tokens) and tokens[k].startswith("_"):
                names.append(tokens[k].lower())
                k += 1
            while k < len(tokens) and not tokens[k].startswith("_") and tokens[k].lower() != "loop_" and not tokens[k].lower().startswith("data_"):
                rows.append(tokens[k])
                k += 1
            loops.append((names, [rows[a : a + len(names)] for a in range(0, len(rows) - len(names) + 1, len(names))]))
        elif t.startswith("_") and k < len(tokens):
            single[t.lower()] = tokens[k]
            k += 1
    try:
        cell = lattice_from_parameters(*[_clean(single[f"_cell_{n}"]) for n in ("length_a", "length_b", "length_c", "angle_alpha", "angle_beta", "angle_gamma")])
    except KeyError as e:
        raise ValueError(f"missing {e.args[0]}") from e
    operations, sites = [], []
    for names, rows in loops:
        for key in ("_symmetry_equiv_pos_as_xyz", "_space_group_symop_operation_xyz"):
            if key in names:
                operations = [symmetry_operation(r[names.index(key)]) for r in rows]
        if "_atom_site_fract_x" in names:
            kind = names.index("_atom_site_type_symbol") if "_atom_site_type_symbol" in names else names.index("_atom_site_label")
            sites = [(re.sub(r"[\d+-]", "", r[kind]), [_clean(r[names.index(f"_atom_site_fract_{c}")]) for c in "xyz"]) for r in rows]
    frame = Frame(cell)
    for symbol, at in sites:
        for turn, shift in operations or [(np.eye(3), np.zeros(3))]:
            p = turn @ np.array(at) + shift
            p -= np.floor(p)
            p[p > 1 - 1e-9] = 0.0
            gaps = [np.array(q) - p for s, q in zip(frame.symbols, frame.positions, strict=True) if s == symbol]
            if not any(np.abs(g - np.round(g)).max() < 1e-4 for g in gaps):
                frame.symbols.append(symbol)
                frame.positions.append(p.tolist())
    return [frame.placed(True)]


def _car_cell(line: str) -> list[float]:
    v = _numbers(line[3:])
    return lattice_from_parameters(*v[:6])


@parser("car", "car")
def car(text: str) -> list[Frame]:
    return _archive(text)[:1]


@parser("arc", "arc", trajectory=True)
def arc(text: str) -> list[Frame]:
    return _archive(text)


def _archive(text: str) -> list[Frame]:
    """CAR and ARC: a cell line, rows of an atom with its element in column 8, `end` after each frame, an energy on a line of its own."""
    out, frame = [], None
    cell, energy = [100.0, 0, 0, 0, 100.0, 0, 0, 0, 100.0], 0.0
    for line in text.splitlines():
        words = line.split()
        if not words:
            continue
        if words[0] == "PBC" and len(words) >= 7:
            cell = _car_cell(line)
            frame = Frame(list(cell), energy=energy)
        elif line.startswith("PBC=OFF"):
            cell = [100.0, 0.0, 0.0, 0.0, 100.0, 0.0, 0.0, 0.0, 100.0]
        elif words[0].lower() == "end":
            if frame and frame.symbols:
                out.append(frame)
            frame = None
        elif len(words) == 1 and len(_numbers(line)) == 1:
            energy = float(words[0])
        elif len(words) >= 8 and len(v := _numbers(" ".join(words[1:4]))) == 3:
            frame = frame or Frame(list(cell), energy=energy)
            frame.symbols.append(words[7])
            frame.positions.append(v)
    return out + [frame] * bool(frame and frame.symbols)


def _castep_blocks(text: str, comments: bool, unit_lines: bool) -> list[Frame]:
    """%BLOCK sections for the cell and the atoms."""
    if comments:
        text = re.sub(r"[#!].*", "", text)
    blocks = {m[1].lower(): m[2].strip().splitlines() for m in re.finditer(r"(?ims)^\s*%block\s+(\w+)\s*\n(.*?)^\s*%endblock", text)}
    cell = [0.0] * 9
    rows = lambda name: [x for x in blocks.get(name, []) if x.strip() and not (unit_lines and x.strip().lower() in ("ang", "angstrom", "bohr"))]
    for name in ("lattice_cart", "lattice_abc"):
        v = [_numbers(x, 3) for x in rows(name) if len(_numbers(x)) >= 3]
        if name == "lattice_cart" and len(v) >= 3:
            cell = [n for x in v[:3] for n in x]
        elif len(v) >= 2:
            cell = lattice_from_parameters(*v[0], *v[1])
    for name, fractional in (("positions_frac", True), ("positions_abs", False)):
        if name in blocks:
            frame = Frame(cell)
            for x in rows(name):
                w = x.split()
                if len(w) >= 4 and len(v := _numbers(" ".join(w[1:4]))) == 3:
                    frame.symbols.append(w[0])
                    frame.positions.append(v)
            return [frame.placed(fractional, wrap=fractional)]
    return []


@parser("castep_cell", "cell")
def castep_cell(text: str) -> list[Frame]:
    return _castep_blocks(text, comments=True, unit_lines=True)


@parser("onetep", "dat")
def onetep(text: str) -> list[Frame]:
    return _castep_blocks(text, comments=True, unit_lines=True)


@parser("castep_md", "md", trajectory=True)
def castep_md(text: str) -> list[Frame]:
    out, frame, cell = [], None, []
    body = re.split(r"\n\s*\n", text, maxsplit=1)
    for line in (body[1] if len(body) > 1 else text).splitlines():
        words = line.split()
        if len(words) < 3 or words[-2] != "<--":
            continue
        tag = words[-1]
        if tag == "E":
            if frame and frame.symbols:
                out.append(frame)
            frame, fresh = Frame(list(cell) or [0.0] * 9, energy=float(words[0])), []
        elif frame and tag == "h":
            fresh += [BOHR * v for v in _numbers(line, 3)]
            if len(fresh) == 9:
                cell = frame.lattice = list(fresh)
        elif frame and tag == "R":
            frame.symbols.append(words[0])
            frame.positions.append([BOHR * float(w) for w in words[2:5]])
    return out + [frame] * bool(frame and frame.symbols)


@parser("outmol", "outmol", trajectory=True)
def outmol(text: str) -> list[Frame]:
    cell, out, frame, mode = [0.0] * 9, [], None, None
    rows: list[float] = []
    for line in text.splitlines():
        low, words = line.strip().lower(), line.split()
        if low.startswith("$cell vectors"):
            mode, rows = "cell", []
        elif low.startswith("$coordinates"):
            mode, frame = "coordinates", Frame(list(cell))
        elif "ATOMIC  COORDINATES (au)" in line:
            if frame and frame.symbols:
                out.append(frame)
            mode, frame = "rows", Frame(list(cell))
        elif low.startswith("$end"):
            if frame and frame.symbols and mode == "coordinates":
                out.append(frame)
                frame = None
            mode = None
        elif mode == "cell" and len(v := _numbers(line, 3)) == 3:
            rows += v
            if len(rows) == 9:
                cell, mode = [BOHR * x for x in rows], None
        elif mode == "coordinates" and len(words) >= 4 and len(v := _numbers(" ".join(words[1:4]))) == 3:
            frame.symbols.append(words[0])
            frame.positions.append([BOHR * x for x in v])
        elif mode == "rows" and words[:1] == ["df"] and len(words) >= 5 and len(v := _numbers(" ".join(words[2:5]))) == 3:
            frame.symbols.append(words[1])
            frame.positions.append([BOHR * x for x in v])
    return out + [frame] * bool(frame and frame.symbols)


_NAMES = {"poscar": "vasp", "contcar": "vasp", "xdatcar": "xdatcar"}


def extensions() -> dict[str, str]:
    return {e: name for name, (_, es, _) in PARSERS.items() for e in es}


def format_of(path: str, head: str = "") -> str:
    """The format by name, extension, or for .in and .out by the first 200 lines. Raises ValueError if unknown."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    base, _, extension = name.rpartition(".")
    extension = extension.lower() if base else ""
    if extension in ("in", "out", "inp"):
        for line in head.splitlines()[:200]:
            if re.search(r"CELL_PARAMETERS|ATOMIC_POSITIONS|&CONTROL|&SYSTEM|Program PWSCF", line, re.I):
                return "espresso"
            if re.search(r"&FORCE_EVAL|&GLOBAL|&COORD|&CELL|CP2K\|", line):
                return "cp2k"
    if extension == "out":
        return "cp2k"
    if extension in (known := extensions()):
        return known[extension]
    for key, value in _NAMES.items():
        if name.lower().startswith(key):
            return value
    raise ValueError(f"unknown structure format: {path}")


def parse(text: str, fmt: str) -> list[Frame]:
    if fmt not in PARSERS:
        raise ValueError(f"unknown structure format: {fmt}")
    try:
        return PARSERS[fmt][0](text)
    except (IndexError, TypeError, UnboundLocalError) as e:
        raise ValueError(f"not a readable {fmt} file: {e}") from e


def volume(lattice: list[float]) -> float:
    return abs(float(np.linalg.det(np.array(lattice).reshape(3, 3)))) if len(lattice) == 9 else math.nan
