"""Settings of a run, checked when they are made, and their JSON form."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field

from .functions.chemistry import Z, parse_formula


def _one_of(value, allowed, name: str) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {sorted(map(str, allowed))}, not {value!r}")


def _elements(names, what: str) -> None:
    bad = [e for e in names if e not in Z]
    if bad:
        raise ValueError(f"unknown {what}: {bad}")


@dataclass(frozen=True)
class Microscope:
    id: str = "microscope"
    type: str = "SEM"
    detector_type: str = "BSD"
    is_auto_bc: bool = True
    brightness: float | None = None
    contrast: float | None = None
    energy_zero: float = 0.0
    bin_width: float = 0.01

    def __post_init__(self):
        _one_of(self.type, {"SEM", "STEM"}, "microscope type")
        if not self.bin_width > 0:
            raise ValueError("bin_width must be positive")


@dataclass(frozen=True)
class Sample:
    id: str = "sample"
    elements: tuple[str, ...] = ()
    type: str = "powder"
    w_frs: dict[str, float] | None = None
    center_pos: tuple[float, float] = (0.0, 0.0)
    half_width_mm: float = 3.0

    def __post_init__(self):
        _elements(self.elements, "elements")
        _one_of(self.type, {"powder", "powder_continuous", "bulk", "bulk_rough"}, "sample type")


@dataclass(frozen=True)
class Substrate:
    elements: tuple[str, ...] = ("C", "O", "Al")
    type: str = "Ctape"
    shape: str = "circle"

    def __post_init__(self):
        _elements(self.elements, "substrate elements")
        _one_of(self.shape, {"circle", "square"}, "substrate shape")


@dataclass(frozen=True)
class Measurement:
    type: str = "EDS"
    mode: str = "point"
    working_distance: float | None = None
    beam_energy_kev: float = 15.0
    beam_current: float | None = None
    emergence_angle: float = 28.5
    is_manual_navigation: bool = False
    max_acquisition_time: float | None = None
    target_counts: float = 50000.0
    min_n_spectra: int = 50
    max_n_spectra: int = 100

    def __post_init__(self):
        if not self.beam_energy_kev > 0 or not 0 < self.emergence_angle < 90:
            raise ValueError("beam energy must be positive and the emergence angle within 0 and 90 degrees")
        if self.max_n_spectra < self.min_n_spectra:
            raise ValueError("max_n_spectra is below min_n_spectra")


@dataclass(frozen=True)
class Quantification:
    method: str = "PB"
    spectrum_lims: tuple[int, int] = (14, 1100)
    fit_tolerance: float = 1e-3
    min_background_counts: float | None = None
    use_instrument_background: bool = False

    def __post_init__(self):
        _one_of(self.method, {"PB"}, "quantification method")
        if self.spectrum_lims[0] >= self.spectrum_lims[1]:
            raise ValueError("spectrum_lims must ascend")

    def background_limit(self, target_counts: float) -> float:
        """Least background counts; by default a share of the target."""
        return self.min_background_counts or target_counts / 2e4


@dataclass(frozen=True)
class PowderMeasurement:
    par_search_frame_width_um: float | None = None
    is_known_powder_mixture: bool = False
    max_n_par_per_frame: int = 30
    max_spectra_per_par: int = 3
    max_area_par: float = 300.0
    min_area_par: float = 10.0
    par_mask_margin: float = 1.0
    xsp_spots_distance_um: float = 1.0
    par_brightness_thresh: int = 100
    par_xy_spots_thresh: int = 100
    par_segmentation_model: str = "threshold_bright"
    par_feature_selection: str = "random"
    par_spot_spacing: str = "random"

    def __post_init__(self):
        _one_of(self.par_feature_selection, {"random", "peaks"}, "par_feature_selection")
        _one_of(self.par_spot_spacing, {"random", "maximized"}, "par_spot_spacing")
        if self.min_area_par > self.max_area_par:
            raise ValueError("min_area_par is above max_area_par")


@dataclass(frozen=True)
class BulkMeasurement:
    grid_spot_spacing_um: float = 100.0
    min_xsp_spots_distance_um: float = 5.0
    image_frame_width_um: float | None = None
    randomize_frames: bool = False
    exclude_sample_margin: bool = False


@dataclass(frozen=True)
class ExperimentalStandards:
    is_exp_std_measurement: bool = False
    formula: str = ""
    min_acceptable_pb_ratio: float = 10.0
    quant_flags_accepted: tuple[int, ...] = (0,)

    def __post_init__(self):
        if self.formula:
            parse_formula(self.formula)


@dataclass(frozen=True)
class Clustering:
    method: str = "kmeans"
    features: str = "at_fr"
    k: int | None = None
    k_finding_method: str = "silhouette"
    max_k: int = 6
    ref_formulae: tuple[str, ...] = ()
    max_analytical_error_percent: float | None = 5.0
    quant_flags_accepted: tuple[int, ...] = (0, -1)
    seed: int = 0

    def __post_init__(self):
        _one_of(self.method, {"kmeans"}, "clustering method")
        _one_of(self.features, {"at_fr", "w_fr"}, "clustering features")
        _one_of(self.k_finding_method, {"silhouette", "calinski_harabasz", "elbow", "forced"}, "k_finding_method")
        if self.k is not None and self.k < 0:
            raise ValueError("k must not be negative")


@dataclass(frozen=True)
class Config:
    """All settings of a sample. ``metadata`` keeps what a file holds besides them."""

    sample: Sample = field(default_factory=Sample)
    microscope: Microscope = field(default_factory=Microscope)
    substrate: Substrate = field(default_factory=Substrate)
    measurement: Measurement = field(default_factory=Measurement)
    quant: Quantification = field(default_factory=Quantification)
    powder: PowderMeasurement | None = None
    bulk: BulkMeasurement | None = None
    standards: ExperimentalStandards | None = None
    clustering: Clustering = field(default_factory=Clustering)
    metadata: dict = field(default_factory=dict)


def default_clustering(elements: list[str], undetectable: tuple[str, ...] = ("H", "He", "Li")) -> Clustering:
    """Settings that a sample's elements suggest: mass fractions if an element cannot be seen or there are only two, and silhouettes for over two."""
    hidden = any(e in undetectable for e in elements)
    return Clustering(features="w_fr" if hidden or len(elements) == 2 else "at_fr", k_finding_method="silhouette" if len(elements) > 2 else "calinski_harabasz")


def _make(kind, values: dict):
    """A settings object from a file's keys in any case; keys that it does not know come back too."""
    fields = {f.name.lower(): f.name for f in dataclasses.fields(kind)}
    known = {fields[k.lower()]: v for k, v in values.items() if k.lower() in fields}
    fixed = {k: tuple(v) if isinstance(v, list) else v for k, v in known.items()}
    for k in ("brightness", "contrast"):
        if isinstance(fixed.get(k), str):
            fixed[k] = float(fixed[k]) if fixed[k].strip() else None
    return kind(**fixed), {k: v for k, v in values.items() if k.lower() not in fields}


#: Sections of a config file and the settings they hold.
SECTIONS = {
    "sample_cfg": ("sample", Sample), "microscope_cfg": ("microscope", Microscope), "sample_substrate_cfg": ("substrate", Substrate), "measurement_cfg": ("measurement", Measurement),
    "quant_cfg": ("quant", Quantification), "powder_meas_cfg": ("powder", PowderMeasurement), "bulk_meas_cfg": ("bulk", BulkMeasurement), "exp_stds_cfg": ("standards", ExperimentalStandards), "clustering_cfg": ("clustering", Clustering),
}


def loads(text: str) -> Config:
    """Settings of a config file: absent sections keep their defaults, unknown keys go to ``metadata``; Infinity and NaN may occur."""
    data, made, rest = json.loads(text), {}, {}
    for name, value in data.items():
        if name in SECTIONS and isinstance(value, dict):
            field_, kind = SECTIONS[name]
            made[field_], more = _make(kind, value)
            if more:
                rest[name] = more
        else:
            rest[name] = value
    return Config(**made, metadata=rest)


def dumps(config: Config, timestamp: str) -> str:
    """The config file of a run: bulk or powder section by the sample's type, and standards or clustering settings."""
    parts = {"datetime": timestamp}
    bulk = config.sample.type.startswith("bulk")
    for name, (field_, _) in SECTIONS.items():
        value = getattr(config, field_)
        if value is None or field_ == ("powder" if bulk else "bulk") or field_ == "clustering" and config.standards is not None:
            continue
        parts[name] = dataclasses.asdict(value)
    return json.dumps(parts, indent=2)
