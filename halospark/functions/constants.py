"""Fixed values that results depend on (c.g.s. units unless noted)."""

from math import pi

# --- fixed values: physical constants -------------------------------------------------------------------
BOLTZMANN = 1.380658e-16
LIGHT_SPEED = 2.99792458e10
GRAVITY = 6.67259e-8
HYDROGEN_MASS = 1.6733e-24
KPC = 3.08567758e21
MPC = 3.08567758e24
SOLAR_MASS = 1.989e33
YEAR = 3.1536e7
# mean density of a flat universe with H0 = 100 km/s/Mpc
RHO_BAR = 3.0 * (100.0e5 / MPC) ** 2 / (8.0 * pi * GRAVITY)

# --- fixed values: simulation code units ----------------------------------------------------------------
CODE_LENGTH = 3.085678e21
CODE_MASS = 1.989e43
CODE_VELOCITY = 1.0e5
CODE_MAGNETIC = 1.0

# --- fixed values: display units (kpc, solar mass, Myr, H/cm^3, km/s, 10^4 K, gauss) --------------------
SYSTEM_UNITS = {
    "length": 3.085678e21,
    "mass": 1.989e33,
    "time": 3.1536e13,
    "density": 1.6733e-24,
    "velocity": 1.0e5,
    "energy": 9.40626e11,
    "magneticfield": 1.0,
}

# --- fixed values: default cosmology --------------------------------------------------------------------
OMEGA_M = 0.30
OMEGA_L = 0.70
OMEGA_B = 0.045
HUBBLE = 0.7
HYDROGEN_FRACTION = 0.76

# --- fixed values: element order of the metals vector and solar abundances ------------------------------
ELEMENTS = ("Z", "Y", "C", "N", "O", "Ne", "Mg", "Si", "S", "Ca", "Fe")
SOLAR = {"O": 8.65e-3, "Ne": 2.22e-3, "Si": 1.08e-3, "Fe": 1.73e-3}
# oxygen mass -> total metal mass on the phase grid
METALS_PER_OXYGEN = 0.0122

# --- fixed values: constants of the phase grid (they differ slightly from the table above) --------------
GRID_BOLTZMANN = 1.3806e-16
GRID_PROTON_MASS = 1.6726e-24
GRID_RHO_CRIT = 1.8791e-29
PHASE_X = (-1.5, 7.0)
PHASE_Y = (3.0, 8.0)
PHASE_CELLS = 256

# --- fixed values: ion tables ---------------------------------------------------------------------------
ION_NH_LOW, ION_NH_STEP, ION_NH_POINTS = -9.0, 0.05, 240
ION_T_LOW, ION_T_STEP, ION_T_POINTS = 2.5, 0.05, 140
ION_HYDROGEN_MASS = 1.673e-24

# --- fixed values: thresholds, particle types, labels ---------------------------------------------------
LOGT_THRESHOLD = 5.5
PTYPE = {"gas": 0, "dark": 1, "star": 4, "bh": 5}
SELF, PARENT, SAT, SIB, IGM = "SELF", "PARENT", "SAT", "SIB", "IGM"

