"""Fixed values of the workload."""

from dataclasses import dataclass

SOURCE_CRS, TARGET_CRS = "EPSG:4326", "EPSG:2953"
#: Study area: lon_min, lat_min, lon_max, lat_max.
BBOX = (-66.85, 47.10, -65.20, 47.95)
POSITIVE_BUFFER_M, NEGATIVE_BUFFER_M, EXCLUDED_TO_M = 500.0, 500.0, 1500.0
RESOLUTION_M, DERIVATIVE_RESOLUTION_M = 100.0, 50.0
NODATA = -9999.0
FOLDS, SEED, TRIALS, MAX_NULL_FRACTION = 5, 42, 50, 0.50
EPS_GRID, EPS_TABLE = 1e-10, 1e-6
NEAREST_M, PAGE, TILE, SCORING_BATCH = 1000.0, 1000, 256, 50_000
#: REST envelope in the target CRS: x_min, y_min, x_max, y_max.
ENVELOPE = (2310000, 7410000, 2740000, 7660000)
RASTER_EXTENSIONS = (".tif", ".tiff", ".asc", ".grd")
RASTER_FEATURES = [
    "mag_tmi", "mag_rmi_fvd_bmc", "mag_rmi_thg_bmc", "mag_rmi_as_bmc", "mag_rmi_tdr_bmc", "mag_rmi_thdr_bmc", "mag_rmi_svd_bmc",
    "rad_k", "rad_th", "rad_u", "rad_k_th_ratio", "em_conductivity", "gravity_bouguer",
]
ASSAYS = ["zn_ppm", "pb_ppm", "cu_ppm", "ag_ppm", "au_ppb", "as_ppm"]
#: Which file stem gives which band; files that are not named here keep their stem.
BAND_CATALOGUE = {"mag_tmi_nb_2013": "mag_tmi", "mag_fvd_nb_2013": "mag_rmi_fvd_bmc", "rad_k_nb_compiled": "rad_k", "rad_th_nb_compiled": "rad_th", "rad_u_nb_compiled": "rad_u"}


@dataclass(frozen=True)
class GridMeta:
    """A grid of square or oblong cells: top-left corner, cell size (dy positive, rows go down), size in cells."""

    x0: float
    y0: float
    dx: float
    dy: float
    width: int
    height: int
    crs: str = TARGET_CRS
    nodata: float = NODATA
