"""Options of table detection: presets, knobs and the ``name=value;...`` tuning text."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field, fields, replace


@dataclass(frozen=True)
class TextOptions:
    """What becomes page text."""

    reading_order: bool = True
    insert_spaces: bool = True
    upright: bool = True
    invisible: bool = True
    forms: bool = False


@dataclass(frozen=True)
class Knobs:
    """Tolerances in points, shares and counts. Keys of a tuning text are these names."""

    snap: float = 2.0
    min_cell: float = 3.0
    min_segment: float = 5.0
    joint_gap: float = 3.5
    min_joints: int = 4
    max_rows: int = 80
    max_cols: int = 40
    max_empty: float = 0.90
    min_filled: int = 4
    min_fill: float = 0.08
    weak_edge: float = 0.55
    edge_cover: float = 0.45
    joints_per_line: int = 2
    min_area: float = 900.0
    v_span: float = 0.40
    h_span: float = 0.22
    hybrid_floor: float = 0.72
    frame_side: float = 0.55
    frame_sum: float = 2.5
    frame_least: float = 40.0
    body_size: float = 1.35
    anchor_support: float = 1 / 3
    min_lines: int = 3
    prose_chars: float = 70.0
    stream_fill: float = 0.25
    nms_iou: float = 0.60
    own_iou: float = 0.15
    own_containment: float = 0.85
    min_confidence_lattice: float = 0.55
    min_confidence_hybrid: float = 0.55
    min_confidence_network: float = 0.50
    stitch_band: float = 0.30
    stitch_reach: float = 0.45
    stitch_dx: float = 12.0
    stitch_header: float = 0.85
    gutter: float = 15.0
    gutter_ratio: float = 0.6
    gutter_fill: float = 0.15
    gap_sizes: float = 4.0
    gap_least: float = 24.0
    column_gap: float = 0.30
    strong_lattice: float = 0.65
    nms_inside: float = 0.82
    tiny_side: int = 2
    tiny_filled: int = 4
    min_data_score: float = 0.42
    overdense: float = 1.35
    y_small_delta: int = 2
    y_small_growth: float = 1.4
    y_least_rows: int = 6
    y_wrap_from: float = 1.4
    y_wrap_to: float = 2.6
    y_prose_cols: int = 6
    y_prose_most: int = 5
    y_prose_least: int = 2
    y_prose_numeric: float = 0.22
    x_most: int = 14
    x_factor: float = 3.5
    x_add: float = 2.0
    x_narrow: int = 1
    x_outside: float = 0.55
    x_short: int = 14
    pitch_variation: float = 0.45
    raster_v_span: float = 0.15
    raster_h_span: float = 0.10
    long_h_ratio: float = 1.5
    long_h_width: float = 0.55
    safe_cols: int = 3
    safe_rows: int = 20
    raster_radius: int = 6
    raster_bias: int = 12
    raster_kernel: int = 15
    raster_segment: int = 8
    raster_gap: int = 4
    raster_snap: float = 2.0
    tables_per_page: int = 32
    logical_cap: int = 32
    overseg: int = 8


@dataclass(frozen=True)
class TableOptions:
    """Which detectors run, and how their candidates become tables."""

    detect: bool = False
    lattice: bool = True
    hybrid: bool = True
    network: bool = True
    #: The whitespace detector, where the network detector finds nothing.
    classic: bool = False
    stitch: bool = False
    split: bool = True
    #: Sure ruled tables keep borderless ones off their page.
    exclusive: bool = True
    #: The exclusive router; without it candidates are suppressed by method and quality.
    router: bool = True
    forms: bool = True
    #: Lines painted in images; empty cells are allowed there.
    raster: bool = True
    densify: bool = True
    collapse: bool = True
    #: Pages are drawn by a program for line search: when asked, or where text is all there is.
    render: bool = False
    auto_render: bool = False
    diagnostics: bool = False
    knobs: Knobs = field(default_factory=Knobs)


_PRODUCT = Knobs(tables_per_page=12, min_confidence_network=0.62, prose_chars=48.0)
_AUTO = TableOptions(True, stitch=True, auto_render=True, knobs=_PRODUCT)

PRESETS = {
    "off": TableOptions(),
    "lattice_only": TableOptions(True, hybrid=False, network=False, router=False),
    "lattice_stream": TableOptions(True, hybrid=False, classic=True, router=False),
    "auto": _AUTO,
    "full": _AUTO,
    "engine_v2": replace(_AUTO, diagnostics=True),
    "high_quality": replace(_AUTO, render=True, diagnostics=True),
    "fast": replace(_AUTO, auto_render=False),
}

#: Other names of knobs and options, as settings files of comparable engines write them.
ALIASES = {
    "line_snap_tol": "snap", "min_cell_size": "min_cell", "lattice_min_seg_len": "min_segment", "lattice_joint_gap": "joint_gap", "lattice_min_joints": "min_joints",
    "lattice_max_rows": "max_rows", "lattice_max_cols": "max_cols", "lattice_empty_frac_reject": "max_empty", "lattice_min_filled_cells": "min_filled", "lattice_min_fill_rate": "min_fill",
    "lattice_weak_edge_threshold": "weak_edge", "lattice_edge_cover_frac": "edge_cover", "lattice_min_joints_per_line": "joints_per_line", "lattice_min_table_area": "min_area",
    "lattice_min_side_for_tiny_reject": "tiny_side", "lattice_tiny_max_filled": "tiny_filled", "lattice_overdense_h_factor": "overdense", "lattice_v_span_frac": "v_span", "lattice_h_span_frac": "h_span",
    "lattice_raster_v_span_frac": "raster_v_span", "lattice_raster_h_span_frac": "raster_h_span", "lattice_long_h_recover_ratio": "long_h_ratio", "lattice_long_h_width_frac": "long_h_width",
    "hybrid_min_conf_when_grid": "hybrid_floor", "strong_lattice_min_conf": "strong_lattice", "nms_containment_frac": "nms_inside", "min_confidence_stream": "min_confidence_network",
    "stream_max_prose_mean_chars": "prose_chars", "stream_min_col_sep": "column_gap", "stream_min_body_bands": "min_lines", "stream_region_gap_font_mult": "gap_sizes", "stream_region_gap_min": "gap_least",
    "stitch_band_frac": "stitch_band", "stitch_max_col_dx": "stitch_dx", "stitch_min_header_sim": "stitch_header", "min_gutter_gap": "gutter", "min_gutter_vs_col": "gutter_ratio",
    "overseg_trigger": "overseg", "max_logical_tables": "logical_cap", "min_data_table_score": "min_data_score", "max_tables_per_page": "tables_per_page",
    "densify_y_small_delta_max": "y_small_delta", "densify_y_small_growth_max": "y_small_growth", "densify_y_explode_min_before": "y_least_rows", "densify_y_explode_growth_lo": "y_wrap_from",
    "densify_y_explode_growth_hi": "y_wrap_to", "densify_y_skip_min_v_cols": "y_prose_cols", "densify_y_skip_max_h_rows": "y_prose_most", "densify_y_skip_min_h_rows": "y_prose_least",
    "densify_y_skip_numeric_frac": "y_prose_numeric", "densify_x_explode_abs_cols": "x_most", "densify_x_explode_growth_factor": "x_factor", "densify_x_explode_growth_add": "x_add",
    "densify_x_narrow_max_extra": "x_narrow", "densify_x_exterior_pad_frac": "x_outside", "densify_x_short_token_chars": "x_short", "densify_pitch_cv_max": "pitch_variation",
    "solid_lattice_stream_safe_max_cols": "safe_cols", "solid_lattice_stream_safe_min_rows": "safe_rows", "raster_adaptive_radius": "raster_radius", "raster_adaptive_bias": "raster_bias",
    "raster_min_kernel": "raster_kernel", "raster_min_seg_px": "raster_segment", "raster_merge_gap_px": "raster_gap", "raster_pos_snap_px": "raster_snap",
    "form_discriminator": "forms", "side_by_side_split": "split", "exclusive_under_strong_lattice": "exclusive", "lattice_collapse_overdense_h": "collapse", "lattice_text_densify": "densify",
    "raster_line_detect": "raster", "use_engine_v2": "router", "allow_classic_stream": "classic", "stitch_multipage": "stitch", "enable_full_page_render": "render", "allow_auto_render": "auto_render",
    "shadow_diagnostics": "diagnostics", "detect_tables": "detect",
}


def preset(name: str) -> TableOptions:
    if name not in PRESETS:
        raise ValueError(f"no preset {name!r}; there are {', '.join(PRESETS)}")
    return PRESETS[name]


def with_setting(options: TableOptions, name: str, value: float) -> TableOptions:
    """The options with one knob, or one switch as 0 or 1, set by its name or another of its names."""
    own = ALIASES.get(name, name)
    number = float(value)
    if not math.isfinite(number):
        raise ValueError(f"{name} must be finite")
    if own == "min_table_confidence":
        return replace(options, knobs=replace(options.knobs, min_confidence_lattice=number, min_confidence_hybrid=number))
    kinds = {f.name: f.type for f in fields(Knobs)}
    switches = {f.name for f in fields(TableOptions)} - {"knobs"}
    if own in switches:
        if number not in (0, 1):
            raise ValueError(f"{name} is 0 or 1")
        return replace(options, **{own: bool(number)})
    if own not in kinds:
        raise ValueError(f"unknown setting {name!r}")
    if kinds[own] == "int":
        if number != int(number) or number < 0:
            raise ValueError(f"{name} must be a whole number")
        number = int(number)
    return replace(options, knobs=replace(options.knobs, **{own: number}))


def tuned(options: TableOptions, text: str) -> TableOptions:
    """The options with ``name=value`` or ``name:value`` items, parted by commas or semicolons."""
    for item in filter(None, (i.strip() for i in text.replace(";", ",").split(","))):
        name, sep, value = item.replace(":", "=").partition("=")
        if not sep:
            raise ValueError(f"no value in {item!r}")
        options = with_setting(options, name.strip(), value)
    return options


def with_settings(options: TableOptions, settings: dict[str, float]) -> TableOptions:
    """The options with every setting of a dictionary, as from JSON."""
    for name, value in settings.items():
        options = with_setting(options, name, value)
    return options


def chosen(name: str | None = None, high_quality: bool = False, auto: bool = False, tuning: str = "") -> TableOptions:
    """A preset by name before high quality before auto before off."""
    own = preset(name) if name else PRESETS["high_quality"] if high_quality else PRESETS["auto"] if auto else PRESETS["off"]
    return tuned(own, tuning) if tuning else own


def as_row(options: TableOptions) -> dict:
    return {k: v for k, v in asdict(options).items() if k != "knobs"} | asdict(options.knobs)


def page_range(text: str, n_pages: int) -> list[int]:
    """0-based pages of ``1-3,5`` as written, repeats kept."""
    out: list[int] = []
    for item in text.split(","):
        a, dash, b = item.strip().partition("-")
        if not a.isdigit() or dash and not b.isdigit():
            raise ValueError(f"bad page range {item!r}")
        first, last = int(a), int(b) if dash else int(a)
        if not 1 <= first <= last <= n_pages:
            raise ValueError(f"pages {item!r} out of 1-{n_pages}")
        out += range(first - 1, last)
    return out
