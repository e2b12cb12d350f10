"""The analysis of a structure or trajectory: options, a registry of calculators, and their shared inputs."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import elements as el
from ..operators import angular, dynamics, hist, order, pairs, radial, scattering, topology, voronoi
from ..operators.near import Near


@dataclass
class Options:
    r_max: float = 20.0
    dr: float = 0.02
    q_max: float = 20.0
    dq: float = 0.02
    angle_width: float = 1.0
    ring_size: int = 8
    entropy_cutoff: float = 5.0
    entropy_sigma: float = 0.2
    samples: int = 10_000
    sample_width: float = 0.2
    time_step: float = 1.0
    sigma: float = 0.1
    kernel: str = "gaussian"
    wavelength: float = 1.5406
    xrd_from: str = "S"  # or "g": from structure factors or from weighted partials
    model_cutoff: float = 5.0
    start: int = 0
    end: int = -1
    ignore_self: bool = True
    bond_ranges: dict[str, tuple[float, float]] = field(default_factory=dict)  # "A-B" to least and greatest distance
    active: dict[str, bool] = field(default_factory=dict)
    disabled_groups: tuple[str, ...] = ()

    def __post_init__(self):
        for name in ("r_max", "dr", "q_max", "dq", "angle_width", "time_step", "sigma", "wavelength"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if self.xrd_from not in ("S", "g"):
            raise ValueError("diffraction is found from S or g")
        if self.ring_size < 3:
            raise ValueError("rings have three atoms or more")

    def save(self, name: str, folder: str | None = None) -> Path:
        path = _presets(folder) / f"{name}.json"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps(asdict(self), indent=1))
        return path

    @classmethod
    def load(cls, name: str, folder: str | None = None) -> Options:
        return cls(**json.loads((_presets(folder) / f"{name}.json").read_text()))


def _presets(folder: str | None) -> Path:
    return Path(folder) if folder else Path.home() / ".lattisphere" / "presets"


def list_presets(folder: str | None = None) -> list[str]:
    return sorted(p.stem for p in _presets(folder).glob("*.json"))


def delete_preset(name: str, folder: str | None = None) -> None:
    (_presets(folder) / f"{name}.json").unlink()


MATERIALS = {"amorphous": Options(), "liquid": Options(dr=0.05, dq=0.05, angle_width=0.5, sigma=0.15), "crystalline": Options(dr=0.002, dq=0.002, angle_width=0.1, sigma=0.01)}


@dataclass(frozen=True)
class Calculator:
    name: str
    short: str
    group: str
    run: Callable[[Analysis], DataFrame]
    trajectory: bool = False


CALCULATORS: dict[str, Calculator] = {}
#: Other names of calculators, which run only when asked for by name; Spark chooses the hardware.
ALIASES = {"BAD": "PAD", "S_Q_GPU": "S_K", "Steinhardt_GPU": "Steinhardt"}


def register_operator(name: str, short: str, group: str, trajectory: bool = False):
    """Adds a calculator: a function of an Analysis that returns frame, hist, bin_idx, x, key, y (without frame for a trajectory's)."""

    def keep(function):
        CALCULATORS[short] = Calculator(name, short, group, function, trajectory)
        return function

    return keep


def list_operators() -> list[Calculator]:
    return list(CALCULATORS.values())


def get_calculator(name: str) -> Calculator:
    """By short or full name, or by an alias."""
    found = CALCULATORS.get(ALIASES.get(name, name)) or next((c for c in CALCULATORS.values() if c.name == name), None)
    if found is None:
        raise KeyError(name)
    return found


class Analysis:
    """frames and atoms with what is built on them; bonds are found once and kept for all calculators."""

    def __init__(self, frames: DataFrame, atoms: DataFrame, options: Options | None = None, model=None):
        self.options, self.model = options or Options(), model
        self.all_atoms, self.all_frames = atoms, frames
        self.atoms = dynamics.frame_window(atoms, self.options.start, self.options.end)
        self.frames = dynamics.frame_window(frames, self.options.start, self.options.end)

    @cached_property
    def cutoffs(self) -> DataFrame:
        spark = self.atoms.sparkSession
        symbols = [r[0] for r in self.atoms.select("element").distinct().collect()]  # 118 at most
        table = el.bond_cutoffs(spark, symbols)
        if not self.options.bond_ranges:
            return table
        own = el.custom_cutoffs(spark, {tuple(k.split("-")): tuple(v) for k, v in self.options.bond_ranges.items()})
        return table.join(own, ["e1", "e2"], "left_anti").unionByName(own)

    @cached_property
    def pairs(self) -> DataFrame:
        """Pairs closer than r_max: some thousands for an atom, so they are counted as they are found and never kept."""
        return pairs.periodic_pairs(self.atoms, self.frames, self.options.r_max, self.options.ignore_self)

    @cached_property
    def bonds(self) -> DataFrame:
        """Bonds, by a search of their own within the longest bond: some ten for an atom, kept for all calculators."""
        longest = self.cutoffs.agg(F.sqrt(F.max("max_sq"))).first()[0] or 0.0
        return pairs.bonds(pairs.periodic_pairs(self.atoms, self.frames, longest + 1e-6, self.options.ignore_self), self.cutoffs).persist()

    @cached_property
    def angles(self) -> DataFrame:
        return angular.angles(self.bonds)

    @cached_property
    def dihedrals(self) -> DataFrame:
        return angular.dihedrals(self.bonds)

    @cached_property
    def rdf(self) -> DataFrame:
        return radial.rdf(self.pairs, self.atoms, self.frames, self.options.r_max, self.options.dr)

    @cached_property
    def structure_factor(self) -> DataFrame:
        return scattering.structure_factor(self.atoms, self.frames, self.options.q_max, self.options.dq)

    @cached_property
    def vacf(self) -> DataFrame:
        moving = dynamics.velocities(self.all_atoms, self.all_frames, self.options.time_step)
        return dynamics.vacf(moving, self.options.time_step)

    @cached_property
    def msd(self) -> DataFrame:
        return dynamics.msd(self.all_atoms, self.all_frames, self.options.time_step)

    def active(self) -> list[Calculator]:
        """All calculators, or those named in options.active by short or full name, less those of disabled groups."""
        on, off = self.options.active, {g.lower() for g in self.options.disabled_groups}
        return [c for c in CALCULATORS.values() if c.group.lower() not in off and (not on or on.get(c.short) or on.get(c.name))]

    def run(self, names: list[str] | None = None) -> dict[str, DataFrame]:
        """Histograms by short name, averaged over frames where they are per frame."""
        chosen = [get_calculator(n) for n in names] if names else self.active()
        return {c.short: c.run(self) if c.trajectory else hist.frame_mean(c.run(self), self.frames) for c in chosen}

    def compute(self, name: str) -> DataFrame:
        """One calculator's histograms, frame by frame."""
        return get_calculator(name).run(self)

    def compute_mean(self, name: str) -> DataFrame:
        """One calculator's histograms, averaged over frames."""
        return next(iter(self.run([name]).values()))

    def smoothed(self, found: DataFrame) -> DataFrame:
        """One histogram with y_smooth, by the options' sigma and kernel."""
        return hist.smoothed(found, self.options.sigma, self.options.kernel)

    def summary(self) -> dict[str, float | None]:
        tau = dynamics.relaxation_time(self.vacf).first()
        return {"D_msd": dynamics.diffusion_from_msd(self.msd).first()[0], "D_vacf": dynamics.diffusion_from_vacf(self.vacf).first()[0], "relaxation_time": tau[0], "deborah": tau[1]}


def _hist(df: DataFrame, name: str, x, y, key=None) -> DataFrame:
    return df.select("frame", F.lit(name).alias("hist"), F.col("bin_idx").cast("long").alias("bin_idx"), x.cast("double").alias("x"), (key if key is not None else F.lit("Total")).alias("key"), y.cast("double").alias("y"))


@register_operator("g(r), J(r), G(r)", "RDF", "Radial")
def _rdf(a: Analysis):
    return a.rdf.select("frame", "hist", "bin_idx", "x", "key", "y")


@register_operator("S(K)", "S_K", "Scattering")
def _sk(a: Analysis):
    return _hist(a.structure_factor, "S_q", F.col("x"), F.col("y"), F.col("key"))


@register_operator("X-ray diffraction", "XRD", "Scattering")
def _xrd(a: Analysis):
    if a.options.xrd_from == "g":
        g = a.rdf.where("hist = 'g_r' and key <> 'Total'").join(radial.pair_weights(a.atoms).select("frame", "key", "w"), ["frame", "key"])
        return _hist(scattering.xrd_from_g(g, a.atoms, a.frames, a.options.wavelength, dr=a.options.dr), "XRD", F.col("x"), F.col("y"))
    return _hist(scattering.xrd_from_s(a.structure_factor, a.atoms, a.options.wavelength, dq=a.options.dq), "XRD", F.col("x"), F.col("y"))


@register_operator("Plane-angle distribution", "PAD", "Angular")
def _pad(a: Analysis):
    return angular.pad(a.angles, a.atoms, a.options.angle_width)


@register_operator("Dihedral-angle distribution", "DAD", "Angular")
def _dad(a: Analysis):
    return angular.dad(a.dihedrals, a.options.angle_width)


@register_operator("Coordination number", "CN", "Structural")
def _cn(a: Analysis):
    return _hist(topology.coordination_counts(a.bonds, a.atoms), "CN", F.col("bin_idx"), F.col("n"), F.col("key"))


@register_operator("Common neighbour analysis", "CNA", "Structural")
def _cna(a: Analysis):
    found = topology.cna(a.bonds)
    place = found.select("signature").distinct().withColumn("bin_idx", F.row_number().over(Window.orderBy("signature")) - 1)  # a row for each signature
    return _hist(found.join(place, "signature"), "CNA", F.col("bin_idx"), F.col("fraction"), F.col("signature"))


@register_operator("Ring distribution", "RD", "Rings")
def _rd(a: Analysis):
    sizes = topology.ring_sizes(topology.rings(a.bonds, a.options.ring_size))
    both = sizes.withColumns({"bin_idx": F.col("size"), "key": F.explode(F.array(F.lit("Rings"), F.lit("Total")))})
    return _hist(both, "RD", F.col("size"), F.col("fraction"), F.col("key"))


@register_operator("Cluster sizes", "Clusters", "Topology")
def _clusters(a: Analysis):
    return _hist(topology.cluster_sizes(topology.clusters(a.bonds, a.atoms)).withColumn("bin_idx", F.col("size")), "Cluster Size", F.col("size"), F.col("n"))


@register_operator("Steinhardt parameters", "Steinhardt", "Order")
def _steinhardt(a: Analysis):
    values = order.steinhardt(a.bonds)
    out = order.value_histogram(values, "q4", "Q4", 0.0, 1.0, 100).unionByName(order.value_histogram(values, "q6", "Q6", 0.0, 1.0, 100))
    return out.unionByName(order.value_histogram(values, "w6_hat", "W6_hat", -0.2, 0.2, 100))


@register_operator("Hydrogen bonds", "HBond", "Structural")
def _hbond(a: Analysis):
    counts = topology.hydrogen_bond_counts(a.atoms, topology.hydrogen_bonds(a.atoms, a.frames, a.bonds))
    total = counts.groupBy("frame").agg(F.sum("n").alias("all"))
    return _hist(counts.join(total, "frame"), "HBond", F.col("bin_idx"), F.col("n") / F.col("all"))


@register_operator("Chirality", "COP", "Order")
def _cop(a: Analysis):
    return order.value_histogram(order.chirality(a.bonds, a.atoms), "chi", "COP", -1.0, 1.0, 100, inclusive=True)


@register_operator("Local entropy", "LEF", "Order")
def _lef(a: Analysis):
    return order.value_histogram(order.local_entropy(a.atoms, a.frames, a.options.entropy_cutoff, a.options.entropy_sigma), "entropy", "LEF", -15.0, 0.0, 150)


@register_operator("Voronoi tessellation", "Voronoi", "Structural")
def _voronoi(a: Analysis):
    return voronoi.distributions(voronoi.voronoi_cells(a.atoms, a.frames))


@register_operator("Density grid", "SDF", "Structural")
def _sdf(a: Analysis):
    grid = order.density_grid(a.atoms, a.frames, max(0.5, a.options.dr))
    both = grid.select("frame", F.col("voxel").alias("bin_idx"), F.explode(F.array("key", F.lit("Total"))).alias("key"), "density")
    return _hist(both.groupBy("frame", "bin_idx", "key").agg(F.sum("density").alias("y")), "SDF", F.lit(0.0), F.col("y"), F.col("key"))


@register_operator("Hyperuniformity", "HU", "Structural")
def _hu(a: Analysis):
    found = order.number_variance(a.atoms, a.frames, a.options.samples, a.options.sample_width)
    return _hist(found, "sigma2_N", F.col("x"), F.col("sigma2")).unionByName(_hist(found, "chi_H", F.col("x"), F.col("chi")))


@register_operator("Mean-squared displacement", "MSD", "Dynamics", trajectory=True)
def _msd(a: Analysis):
    t = a.msd.select(F.col("lag").alias("bin_idx"), F.col("t").alias("x"), F.explode(F.array(F.struct(F.lit("MSD").alias("hist"), F.col("msd").alias("y")), F.struct(F.lit("D_eff").alias("hist"), F.col("d_eff").alias("y")))).alias("v"))
    return t.select("v.hist", "bin_idx", "x", F.lit("Total").alias("key"), "v.y").where("y is not null")


@register_operator("Velocity autocorrelation", "VACF", "Dynamics", trajectory=True)
def _vacf(a: Analysis):
    t = a.vacf.select(F.col("lag").alias("bin_idx"), F.col("t").alias("x"), F.explode(F.array(F.struct(F.lit("VACF").alias("hist"), F.col("vacf").alias("y")), F.struct(F.lit("Normalized VACF").alias("hist"), F.col("vacf_norm").alias("y")))).alias("v"))
    return t.select("v.hist", "bin_idx", "x", F.lit("Total").alias("key"), "v.y")


@register_operator("Vibrational density of states", "VDOS", "Dynamics", trajectory=True)
def _vdos(a: Analysis):
    found = dynamics.vdos(a.vacf, a.options.time_step)
    v = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).alias("y")) for k, c in (("Total", "y"), ("Frequency_cm_1", "cm"), ("Frequency_meV", "mev"))])).alias("v")
    return found.select(F.lit("VDOS").alias("hist"), "bin_idx", F.col("thz").alias("x"), v).select("hist", "bin_idx", "x", "v.key", "v.y")


@register_operator("Learned potential", "MLIP", "Model")
def _mlip(a: Analysis):
    """The energy of each frame by the analysis' model (zero without one)."""
    if a.model is None:
        energies = a.frames.select("frame", F.lit(0.0).alias("energy"))
    else:
        energies = evaluate_model(a.atoms, a.frames, a.model, a.options.model_cutoff)
    return _hist(energies.withColumn("bin_idx", F.lit(0)), "MLIP", F.lit(0.0), F.col("energy"), F.lit("Energy"))


_OUTPUT = "frame long, energy double, per_atom_energy array<double>, forces array<array<double>>, stress array<double>"


def evaluate_model(atoms: DataFrame, frames: DataFrame, model, cutoff: float = 5.0) -> DataFrame:
    """frame, energy, per_atom_energy, forces, stress (nine numbers) of a user's model: a function of (atoms, edges) as pandas
    frames, atoms by atom_id, that returns a mapping with some of these names; what it leaves out is zero, as is everything without a model.

    A task holds one frame with its edges."""
    import pandas as pd

    edges = pairs.graph_edges(atoms, frames, cutoff)
    edges = edges.select(F.col("frame").alias("frame"), *edges.columns[1:])  # a column of its own, which cogroup can tell from that of atoms

    def run(own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame({c: [] for c in ("frame", "energy", "per_atom_energy", "forces", "stress")})
        own = own.sort_values("atom_id")
        n = len(own)
        found = {"energy": 0.0, "per_atom_energy": [0.0] * n, "forces": [[0.0] * 3] * n, "stress": [0.0] * 9, **(model(own, links) if model else {})}
        return pd.DataFrame({"frame": [int(own["frame"].iloc[0])], "energy": [float(found["energy"])], "per_atom_energy": [list(map(float, found["per_atom_energy"]))], "forces": [[list(map(float, f)) for f in found["forces"]]], "stress": [list(map(float, found["stress"]))]})

    return atoms.groupBy("frame").cogroup(edges.groupBy("frame")).applyInPandas(run, _OUTPUT)


def evaluate_local_model(atoms: DataFrame, frames: DataFrame, model, cutoff: float = 5.0) -> DataFrame:
    """frame, atom_id, energy, fx, fy, fz of a user's model whose energy and force of an atom depend on that atom's own edges alone.

    The model is as for evaluate_model, but sees a block of atoms with the edges that leave them; a frame's energy is the sum of its atoms'.
    So a task holds one block, and no frame and no edge is ever written."""
    import numpy as np
    import pandas as pd

    def kernel(b):
        at = b.home[np.argsort(b.ids[b.home])]
        names = np.array(b.kinds, object)
        own = pd.DataFrame({"frame": b.frame, "atom_id": b.ids[at], "element": names[b.kind[at]], **{c: b.r[at, k] for k, c in enumerate("xyz")}})
        i, j, d, v = (np.concatenate(x) for x in zip(*b.bonds(at), strict=True))
        s = b.image[j] - b.image[i]
        links = pd.DataFrame({"frame": b.frame, "src": b.ids[i], "dst": b.ids[j], **{f"s{k + 1}": s[:, k] for k in range(3)}, **{f"r{c}": v[:, k] for k, c in enumerate("xyz")}, "d": d})
        found = {"per_atom_energy": np.zeros(len(at)), "forces": np.zeros((len(at), 3)), **model(own, links)}
        forces = np.asarray([list(f) for f in found["forces"]], float)
        return {"atom_id": b.ids[at], "energy": np.asarray(found["per_atom_energy"], float), **{f"f{c}": forces[:, k] for k, c in enumerate("xyz")}}

    return Near(atoms, frames, cutoff, inclusive=True).run(kernel, "atom_id long, energy double, fx double, fy double, fz double", home=256)


def add(one: dict[str, DataFrame], other: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The histograms of two runs by name, summed where both have one."""
    return {k: hist.added(one[k], other[k]) if k in one and k in other else one.get(k, other.get(k)) for k in {**one, **other}}


def scale(found: dict[str, DataFrame], factor: float) -> dict[str, DataFrame]:
    """All histograms of a run times a factor."""
    return {k: hist.scaled(v, factor) for k, v in found.items()}
