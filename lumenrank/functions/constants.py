"""Fixed values that results must share: residue scales, panels and named sets."""

# Standard residues and residue scales.
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"

HYDROPHOBICITY = {"A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "E": -3.5, "Q": -3.5, "G": -0.4, "H": -3.2, "I": 4.5, "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2}
VDW_VOLUME = {"A": 67, "R": 148, "N": 96, "D": 91, "C": 86, "E": 109, "Q": 114, "G": 48, "H": 118, "I": 124, "L": 124, "K": 135, "M": 124, "F": 135, "P": 90, "S": 73, "T": 93, "W": 163, "Y": 141, "V": 105}
AROMATICITY = {"F": 1, "W": 1, "Y": 1, "H": 1}
CHARGE = {"K": 1, "R": 1, "D": -1, "E": -1}
FLEXIBILITY = {"A": 0.984, "C": 0.906, "D": 1.068, "E": 1.094, "F": 0.915, "G": 1.031, "H": 0.950, "I": 0.927, "K": 1.102, "L": 0.935, "M": 0.952, "N": 1.048, "P": 1.049, "Q": 1.037, "R": 1.008, "S": 1.046, "T": 0.997, "V": 0.931, "W": 0.904, "Y": 0.929}
BULKINESS = {"A": 11.5, "C": 13.46, "D": 11.68, "E": 13.57, "F": 19.8, "G": 3.4, "H": 13.69, "I": 21.4, "K": 15.71, "L": 21.4, "M": 16.25, "N": 12.82, "P": 17.43, "Q": 14.45, "R": 14.28, "S": 9.47, "T": 15.77, "V": 21.57, "W": 21.67, "Y": 18.03}
HYDROPHILICITY = {"A": -0.5, "C": -1.0, "D": 3.0, "E": 3.0, "F": -2.5, "G": 0.0, "H": -0.5, "I": -1.8, "K": 3.0, "L": -1.8, "M": -1.3, "N": 0.2, "P": 0.0, "Q": 0.2, "R": 3.0, "S": 0.3, "T": -0.4, "V": -1.5, "W": -3.4, "Y": -2.3}

# Exposure of a contact position by sequence length; other lengths use 9.
UPWARD = {
    8: {"p4": 0.8, "p5": 0.9, "p6": 0.8, "p7": 0.0, "p8": 0.0},
    9: {"p4": 0.6, "p5": 0.9, "p6": 0.9, "p7": 0.7, "p8": 0.6},
    10: {"p4": 0.5, "p5": 0.8, "p6": 0.9, "p7": 0.8, "p8": 0.5},
    11: {"p4": 0.4, "p5": 0.7, "p6": 0.8, "p7": 0.8, "p8": 0.4},
}

SCALES = {"hydrophobicity": HYDROPHOBICITY, "aromaticity": AROMATICITY, "vdw_volume": VDW_VOLUME, "charge": CHARGE, "flexibility": FLEXIBILITY, "bulkiness": BULKINESS, "hydrophilicity": HYDROPHILICITY}
POSITIONS = ("p4", "p5", "p6", "p7", "p8")
LENGTHS = (8, 9, 10, 11)

# The allele panel, and the columns of its scores.
ALLELES = ("HLA-A*02:01", "HLA-A*01:01", "HLA-A*03:01", "HLA-A*24:02", "HLA-A*11:01", "HLA-B*07:02", "HLA-B*08:01", "HLA-B*27:05", "HLA-B*35:01", "HLA-B*44:02")
ALLELE_COLUMNS = ("bind_A0101", "bind_A0201", "bind_A0301", "bind_A1101", "bind_A2402", "bind_B0702", "bind_B0801", "bind_B2705", "bind_B3501", "bind_B4402")
CLASS_TWO_PREFIXES = ("HLA-DR", "HLA-DP", "HLA-DQ")

# Validated positives (peptide, protein, allele, virus).
POSITIVES = (
    ("CLGGLLTMV", "LMP2A", "HLA-A*02:01", "EBV"),
    ("GLCTLVAML", "BMLF1", "HLA-A*02:01", "EBV"),
    ("FLRGRAYGI", "EBNA3A", "HLA-B*08:01", "EBV"),
    ("RAKFKQLL", "BZLF1", "HLA-B*08:01", "EBV"),
    ("IVTDFSVIK", "EBNA3B", "HLA-A*11:01", "EBV"),
    ("RPPIFIRRL", "EBNA3A", "HLA-B*27:05", "EBV"),
    ("HPVGEADYFEY", "EBNA1", "HLA-B*35:01", "EBV"),
    ("TYSAGIVQI", "EBNA3B", "HLA-A*24:02", "EBV"),
    ("AVFDRKSDAK", "EBNA3B", "HLA-A*11:01", "EBV"),
    ("YVLDHLIVV", "BRLF1", "HLA-A*02:01", "EBV"),
    ("YMLDLQPET", "HPV16_E7", "HLA-A*02:01", "HPV"),
    ("RAHYNIVTF", "HPV16_E7", "HLA-B*35:01", "HPV"),
    ("LLMGTLGIV", "HPV16_E7", "HLA-A*02:01", "HPV"),
    ("KLPQLCTEL", "HPV16_E6", "HLA-A*02:01", "HPV"),
    ("TIHDIILECV", "HPV16_E6", "HLA-A*02:01", "HPV"),
)

# Strong binders that were tested negative (peptide, allele, virus, affinity in nM or none).
NEGATIVES = (
    ("LIPETVPYI", "HLA-A*02:01", "EBV", 25.8),
    ("LPQGQLTAY", "HLA-B*35:01", "EBV", 26.1),
    ("MLLLIVAGI", "HLA-A*02:01", "EBV", 26.3),
    ("FTYPVLEEM", "HLA-A*02:01", "EBV", 35.4),
    ("SYVKQPLCL", "HLA-A*24:02", "EBV", 41.1),
    ("CLLIRPLLL", "HLA-B*08:01", "HPV", 75.9),
    ("IVYRDGNPY", "HLA-B*35:01", "HPV", 64.1),
    ("RLCVQSTHV", "HLA-A*02:01", "HPV", 38.9),
    ("DKKQRFHNI", "HLA-B*08:01", "HPV", 172.0),
    ("AMFQDPQER", "HLA-A*11:01", "HPV", 101.1),
    ("HYQTLCTNF", "HLA-A*24:02", "EBV", None),
    ("DYMAIHRSL", "HLA-A*24:02", "EBV", None),
    ("AYAEATSSL", "HLA-A*24:02", "EBV", None),
    ("LTEWGSGNRTY", "HLA-A*01:01", "EBV", None),
    ("FYISLIQGL", "HLA-A*24:02", "EBV", None),
    ("FYMTHGLGTL", "HLA-A*24:02", "EBV", None),
    ("FYPLATYPL", "HLA-A*24:02", "EBV", None),
    ("GIDPHLPTL", "HLA-A*02:01", "EBV", None),
    ("NYNPGTLSSL", "HLA-A*24:02", "EBV", None),
    ("IVTDLSIIK", "HLA-A*11:01", "EBV", None),
    ("CYSVYGTTL", "HLA-A*24:02", "HPV", None),
    ("VYLTAPTGCI", "HLA-A*24:02", "HPV", None),
    ("QPETTDLYCY", "HLA-B*35:01", "HPV", None),
    ("LRLCVQSTH", "HLA-B*27:05", "HPV", None),
    ("IVYIIFVYI", "HLA-A*02:01", "HPV", None),
)

# Sequences that never train a model (one positive has two strain variants).
HOLDOUTS = ("CLGGLLTMV", "GLCTLVAML", "FLRGRAYGL", "FLRGRAYGI", "RAKFKQLL", "IVTDFSVIK", "RPPIFIRRL", "HPVGEADYFEY", "TYSAGIVQI", "AVFDRKSDAK", "YVLDHLIVV", "YMLDLQPET", "RAHYNIVTF", "LLMGTLGIV", "KLPQLCTEL", "TIHDIILECV")

# Names of a panel, old and new.
PANEL_ALIASES = {"HPV_8_FASTAs": "HPV16_18_panel8", "EBV_8_FASTAs": "EBV_B95_8_panel8", "EBV_panel8_B958": "EBV_B95_8_panel8"}

# Text patterns in order and what they mean; None asks for the suffixes below.
EBV_GENES = (
    ("lmp1", "LMP1"), ("lmp2", "LMP2A"), ("lmp-2", "LMP2A"), ("lmp 2", "LMP2A"), ("latent membrane protein 1", "LMP1"), ("latent membrane protein 2", "LMP2A"),
    ("ebna1", "EBNA1"), ("ebna-1", "EBNA1"), ("ebna 1", "EBNA1"), ("ebna2", "EBNA2"), ("ebna-2", "EBNA2"), ("ebna3a", "EBNA3A"), ("ebna-3a", "EBNA3A"), ("ebna3", "EBNA3A"),
    ("ebna3b", "EBNA3B"), ("ebna-3b", "EBNA3B"), ("ebna3c", "EBNA3C"), ("ebna-3c", "EBNA3C"), ("bzlf1", "BZLF1"), ("brlf1", "BRLF1"), ("bmlf1", "BMLF1"), ("sm protein", "BMLF1"),
    ("gp350", "GP350"), ("gp340", "GP350"), ("nuclear antigen", None),
)
NUCLEAR_SUFFIXES = ("3a", "3b", "3c", "1", "2", "3")
HPV_GENES = ("E1", "E2", "E4", "E5", "E6", "E7", "L1", "L2")
EBV_STRAINS = (("b95-8", "B95-8"), ("b95.8", "B95-8"), ("b958", "B95-8"), ("gd1", "GD1"), ("ag876", "AG876"), ("akata", "Akata"))
HPV_STRAINS = (("type 16", "HPV16"), ("hpv16", "HPV16"), ("hpv-16", "HPV16"), ("type 18", "HPV18"), ("hpv18", "HPV18"), ("hpv-18", "HPV18"), ("type 11", "HPV11"), ("hpv11", "HPV11"))
FILE_VIRUSES = (("ebv", "EBV"), ("hpv16", "HPV16"), ("hvp16", "HPV16"), ("hpv11", "HPV11"))

# Derived: model input columns in order.
PHYSICO = tuple(f"{p}_{s}" for s in ("hydrophobicity", "aromaticity", "vdw_volume", "charge") for p in POSITIONS)
PHYSICO_WIDE = PHYSICO + tuple(f"{p}_{s}" for s in ("flexibility", "bulkiness", "hydrophilicity", "upward_prob") for p in POSITIONS)
POCKET = tuple(f"hla_p{i}_{s}" for i in range(1, 35) for s in ("hydrophobicity", "aromaticity", "vdw_volume", "charge"))
FEATURE_SETS = {
    21: (*PHYSICO, "peptide_length"),
    22: (*PHYSICO, "binding_score", "peptide_length"),
    30: PHYSICO + ALLELE_COLUMNS,
    31: PHYSICO + ALLELE_COLUMNS + ("peptide_length",),
    50: PHYSICO_WIDE + ALLELE_COLUMNS,
    166: PHYSICO + ALLELE_COLUMNS + POCKET,
}

#: Parts of an organism's lower-cased name and the panel they mean, in the order they are tried.
ORGANISM_VIRUSES = (
    ("human herpesvirus 4", "EBV"), ("epstein barr", "EBV"), ("epstein-barr", "EBV"), ("ebv", "EBV"),
    ("human papillomavirus type 16", "HPV16"), ("hpv16", "HPV16"), ("hpv-16", "HPV16"),
    ("human papillomavirus type 11", "HPV11"), ("hpv11", "HPV11"), ("hpv-11", "HPV11"),
)
