"""Word lists. Results depend on every entry and on the order."""

from __future__ import annotations

# Phrases of characterisation methods, first match wins.
CHARACTERIZATION = (
    ("xrd", "XRD"),
    ("x-ray diffraction", "XRD"),
    ("gixrd", "GIXRD"),
    ("grazing incidence x-ray", "GIXRD"),
    ("saxs", "SAXS"),
    ("waxs", "WAXS"),
    ("rheed", "RHEED"),
    ("leed", "LEED"),
    ("xrf", "XRF"),
    ("sem", "SEM"),
    ("scanning electron", "SEM"),
    ("fesem", "FE-SEM"),
    ("field emission sem", "FE-SEM"),
    ("tem", "TEM"),
    ("transmission electron", "TEM"),
    ("hrtem", "HRTEM"),
    ("high-resolution tem", "HRTEM"),
    ("stem", "STEM"),
    ("haadf", "HAADF-STEM"),
    ("eels", "EELS"),
    ("electron energy loss", "EELS"),
    ("ebsd", "EBSD"),
    ("electron backscatter", "EBSD"),
    ("fib", "FIB"),
    ("focused ion beam", "FIB"),
    ("afm", "AFM"),
    ("atomic force", "AFM"),
    ("stm", "STM"),
    ("scanning tunneling", "STM"),
    ("kpfm", "KPFM"),
    ("kelvin probe", "KPFM"),
    ("pfm", "PFM"),
    ("piezoresponse force", "PFM"),
    ("xps", "XPS"),
    ("x-ray photoelectron", "XPS"),
    ("esca", "XPS"),
    ("ups", "UPS"),
    ("ultraviolet photoelectron", "UPS"),
    ("aes", "AES"),
    ("auger electron", "AES"),
    ("arpes", "ARPES"),
    ("angle-resolved photoemission", "ARPES"),
    ("exafs", "EXAFS"),
    ("extended x-ray absorption", "EXAFS"),
    ("xanes", "XANES"),
    ("near-edge x-ray", "XANES"),
    ("ftir", "FTIR"),
    ("infrared spectroscop", "FTIR"),
    ("atr", "ATR-FTIR"),
    ("attenuated total reflectance", "ATR-FTIR"),
    ("raman", "Raman spectroscopy"),
    ("photoluminescence", "PL spectroscopy"),
    ("cathodoluminescence", "CL"),
    ("electroluminescence", "EL"),
    ("time-resolved photoluminescence", "TRPL"),
    ("time resolved photoluminescence", "TRPL"),
    ("trpl", "TRPL"),
    ("tcspc", "TCSPC"),
    ("shg", "SHG"),
    ("second harmonic generation", "SHG"),
    ("uv-vis", "UV-Vis"),
    ("uv–vis", "UV-Vis"),
    ("uv-vis-nir", "UV-Vis-NIR"),
    ("ellipsomet", "ellipsometry"),
    ("reflectance spectroscop", "reflectance spectroscopy"),
    ("eis", "EIS"),
    ("electrochemical impedance", "EIS"),
    ("cyclic voltammetry", "CV"),
    (" cv ", "CV"),
    ("lsv", "LSV"),
    ("linear sweep voltammetry", "LSV"),
    ("tga", "TGA"),
    ("thermogravimetric", "TGA"),
    ("dsc", "DSC"),
    ("differential scanning calorimetry", "DSC"),
    ("dta", "DTA"),
    ("differential thermal analysis", "DTA"),
    ("bet", "BET"),
    ("brunauer", "BET"),
    ("dls", "DLS"),
    ("dynamic light scattering", "DLS"),
    ("sims", "SIMS"),
    ("secondary ion mass", "SIMS"),
    ("rbs", "RBS"),
    ("rutherford backscattering", "RBS"),
    ("pixe", "PIXE"),
    ("inductively coupled plasma", "ICP"),
    ("gdms", "GDMS"),
    ("gdoes", "GDOES"),
    ("libs", "LIBS"),
    ("dlts", "DLTS"),
    ("deep level transient", "DLTS"),
    ("dlos", "DLOS"),
    ("picts", "PICTS"),
    ("hall effect", "Hall effect"),
    ("four-point probe", "four-point probe"),
    ("four point probe", "four-point probe"),
    ("photoconductivity", "photoconductivity measurement"),
    ("edx", "EDX"),
    ("energy dispersive", "EDX"),
    ("eds", "EDS"),
    ("edax", "EDX"),
    ("wds", "WDS"),
    ("profilometr", "profilometry"),
    ("absorption spectroscop", "absorption spectroscopy"),
)

# Phrases of synthesis methods.
SYNTHESIS = (
    ("molecular beam epitaxy", "MBE"),
    ("chemical vapor deposition", "CVD"),
    ("chemical vapour deposition", "CVD"),
    ("metalorganic chemical vapor", "MOCVD"),
    ("metalorganic cvd", "MOCVD"),
    ("metal-organic cvd", "MOCVD"),
    ("plasma-enhanced cvd", "PECVD"),
    ("plasma enhanced cvd", "PECVD"),
    ("low-pressure cvd", "LPCVD"),
    ("atmospheric pressure cvd", "APCVD"),
    ("atomic layer deposition", "ALD"),
    ("plasma-enhanced ald", "PEALD"),
    ("pulsed laser deposition", "PLD"),
    ("physical vapor deposition", "PVD"),
    ("physical vapour deposition", "PVD"),
    ("rf sputtering", "RF sputtering"),
    ("dc sputtering", "DC sputtering"),
    ("magnetron sputtering", "magnetron sputtering"),
    ("reactive sputtering", "reactive sputtering"),
    ("thermal evaporation", "thermal evaporation"),
    ("electron beam evaporation", "e-beam evaporation"),
    ("e-beam evaporation", "e-beam evaporation"),
    ("metal organic vapor phase", "MOVPE"),
    ("metalorganic vapor phase", "MOVPE"),
    ("halide vapor phase", "HVPE"),
    ("spin coating", "spin coating"),
    ("sol-gel", "sol-gel"),
    ("spray pyrolysis", "spray pyrolysis"),
    ("chemical bath deposition", "CBD"),
    ("successive ionic layer", "SILAR"),
    ("silar", "SILAR"),
    ("electrodeposition", "electrodeposition"),
    ("electroplating", "electroplating"),
    ("hydrothermal", "hydrothermal synthesis"),
    ("solvothermal", "solvothermal synthesis"),
    ("close space sublimation", "CSS"),
    ("close-space sublimation", "CSS"),
)

# Phrases of defects.
DEFECTS = (
    ("selenium vacancy", "Se vacancy (V_Se)"),
    ("se vacancy", "Se vacancy (V_Se)"),
    ("v_se", "Se vacancy (V_Se)"),
    ("vse", "Se vacancy (V_Se)"),
    ("s vacancy", "S vacancy (V_S)"),
    ("sulfur vacancy", "S vacancy (V_S)"),
    ("zinc vacancy", "Zn vacancy (V_Zn)"),
    ("zn vacancy", "Zn vacancy (V_Zn)"),
    ("v_zn", "Zn vacancy (V_Zn)"),
    ("zinc interstitial", "Zn interstitial (Zn_i)"),
    ("zn interstitial", "Zn interstitial (Zn_i)"),
    ("zni", "Zn interstitial (Zn_i)"),
    ("antisite", "antisite defect"),
    ("se_zn", "Se antisite (Se_Zn)"),
    ("zn_se", "Zn antisite (Zn_Se)"),
    ("deep level", "deep-level defect"),
    ("deep trap", "deep-level trap"),
    ("shallow donor", "shallow donor"),
    ("shallow acceptor", "shallow acceptor"),
    ("donor level", "donor level"),
    ("acceptor level", "acceptor level"),
    ("native defect", "native point defect"),
    ("point defect", "point defect"),
    ("stacking fault", "stacking fault"),
    ("dislocation", "dislocation"),
    ("grain boundary", "grain boundary defect"),
)

# Acronyms that name a method other than by themselves; all others of the two lists stand for themselves.
RENAMED_ACRONYMS = (
    ("FESEM", "FE-SEM"),
    ("HRSEM", "HR-SEM"),
    ("HAADF", "HAADF-STEM"),
    ("SKPM", "KPFM"),
    ("CAFM", "C-AFM"),
    ("FIBSEM", "FIB-SEM"),
    ("GIXD", "GIXRD"),
    ("ESCA", "XPS"),
    ("EDAX", "EDX"),
    ("ATR", "ATR-FTIR"),
    ("PL", "PL spectroscopy"),
    ("UVVIS", "UV-Vis"),
    ("UVVISNIR", "UV-Vis-NIR"),
    ("GEIS", "EIS"),
    ("PEIS", "EIS"),
    ("DTGA", "TGA"),
    ("TOFSIMS", "ToF-SIMS"),
    ("ICPMS", "ICP-MS"),
    ("ICPAES", "ICP-AES"),
    ("HALL", "Hall effect"),
    ("ALCVD", "ALD"),
    ("PAMBE", "PA-MBE"),
    ("RFMBE", "RF-MBE"),
)
CHARACTERIZATION_ACRONYMS = (
    "SEM FESEM HRSEM ESEM TEM HRTEM STEM HAADF ETEM AFM STM MFM KPFM SKPM EFM CAFM PFM FIB FIBSEM XRD HRXRD GIXRD GIXD SAXS WAXS GISAXS GIWAXS RHEED LEED SAED CBED "
    "EBSD XRF SXRD XRR XPS ESCA HAXPES UPS AES ARPES ARUPS EXAFS XANES NEXAFS XAS EDS EDX EDAX WDS EPMA EELS HREELS EFTEM FTIR ATR DRIFTS PL TRPL TCSPC CL EL SHG THG "
    "UVVIS UVVISNIR CV EIS LSV GEIS PEIS TGA DSC DTA TMA DTGA BET DLS SIMS TOFSIMS RBS ERDA NRA PIXE NMR EPR ESR DLTS DLOS ICTS PICTS TSC ICP ICPMS ICPAES GDMS GDOES "
    "LIBS CLSM LEEM PEEM HALL"
).split()
SYNTHESIS_ACRONYMS = (
    "CVD MOCVD MOVPE PECVD LPCVD APCVD RTCVD HWCVD ALCVD OMCVD OMVPE VPE HVPE OVPE MBE MOMBE GSMBE CBE PAMBE RFMBE ALD PEALD SALD TALD PVD PLD IBD IBAD CBD SILAR CSS IBS"
).split()
SYNTHESIS_SUFFIXES = ("CVD", "MBE", "PVD", "ALD", "VPE", "PLD")

# Phrases that mark a sentence as noise.
NOISE_PHRASES = (
    "creative commons", "copyright", "all rights reserved", "doi:", "http://", "https://", "www.", "correspondence:", "received:", "accepted:", "published:",
    "journal of", "elsevier", "springer", "wiley", "mdpi", "this article", "this paper", "this work", "this study", "the authors", "author contributions", "funding:",
    "conflict of interest", "supplementary", "©", "™", "®",
)

# What is no value of a fact.
VALUE_BLOCKLIST = (
    "usa uk eu uae us un url doi isbn issn pdf html xml api lc rc dc ac ii iii iv vi vii et al fig eq ref sec vol no mdpi ieee aip acs rsc iop a b c n p x y z"
).split()
GARBLED_MATERIALS = ("coco", "osos", "osco", "fesm", "coos", "tialsi", "tin1", "in2se320", "snte37", "2d materials", "bi2x3", "cucrs258", "cuinp2s616")
GENERIC_MATERIALS = ("layered material", "thin film", "nanoparticle", "nanowire", "quantum dot", "heterostructure", "substrate", "not specified", "various", "unknown")
TECHNIQUE_LABELS = (
    "raman intensity", "pl spectra", "tr spectra", "pl and absorption", "xps spectra", "absorption spectra", "reflectance spectra", "time-resolved spectra",
    "second harmonic generation", "photoluminescence", "raman spectroscopy",
)

# Units as written, folded, and as kept.
UNITS = (
    ("°c", "°C"),
    ("deg c", "°C"),
    ("degrees c", "°C"),
    ("celsius", "°C"),
    ("°f", "°F"),
    ("k", "K"),
    ("kelvin", "K"),
    ("ev", "eV"),
    ("at.%", "at.%"),
    ("at%", "at.%"),
    ("mol.%", "mol.%"),
    ("mol%", "mol.%"),
    ("wt.%", "wt.%"),
    ("wt%", "wt.%"),
    ("cm-3", "cm⁻³"),
    ("cm^-3", "cm⁻³"),
    ("cm⁻3", "cm⁻³"),
    ("nm", "nm"),
    ("um", "μm"),
    ("μm", "μm"),
    ("ns", "ns"),
    ("us", "μs"),
    ("μs", "μs"),
    ("ps", "ps"),
    ("ms", "ms"),
    ("ω·cm", "Ω·cm"),
    ("ohm·cm", "Ω·cm"),
    ("s/cm", "S/cm"),
    ("μa", "μA"),
    ("ma", "mA"),
    ("na", "nA"),
    ("a/w", "A/W"),
    ("ma/w", "mA/W"),
)

# Words that top keywords leave out.
STOP_WORDS = (
    "this that with have been from they were their there what when where which will would could should then than also some into about your just like more very"
).split()

# Section names. Exact names and affixes of noise, and canonical names by exact name, prefix and part.
NOISE_SECTIONS = (
    "references reference bibliography acknowledgements acknowledgement acknowledgments acknowledgment author_contributions author_contribution author_information contributions "
    "data_availability data_availability_statement code_availability competing_interests conflict_of_interest conflicts_of_interest declaration_of_competing_interest "
    "declaration_of_interests funding additional_information supplementary_information supplementary_material supplementary_materials supporting_information copyright orcid "
    "open_access correspondence corresponding_author highlights graphical_abstract figure_captions figures tables keywords abbreviations declarations citation preamble "
    "table_of_contents list_of_figures committee dissertation"
).split()
NOISE_PREFIXES = (
    "received_", "accepted_", "supplementary_note_", "supplementary_text_", "supporting_information_", "acknowledgements_", "acknowledgments_", "data_availability_",
    "declaration_of_competing_interest_", "author_contributions_", "figure_", "eq_",
)
NOISE_SUFFIXES = ("_references", "_acknowledgements", "_acknowledgments", "_acknowledgement")
SECTION_NAMES = (
    ("i_introduction", "introduction"),
    ("ii_introduction", "introduction"),
    ("1_introduction", "introduction"),
    ("experimental", "methods"),
    ("experimental_section", "methods"),
    ("experimental_methods", "methods"),
    ("experimental_procedure", "methods"),
    ("experimental_details", "methods"),
    ("materials_and_methods", "methods"),
    ("result_and_discussion", "results_and_discussion"),
    ("results_and_discussions", "results_and_discussion"),
    ("final_remarks", "conclusion"),
    ("conclusions_and_outlook", "conclusion"),
    ("summary_and_outlook", "conclusion"),
    ("crystal_growth", "synthesis"),
    ("sample_preparation", "synthesis"),
    ("material_preparation", "synthesis"),
    ("characterizations", "characterization"),
    ("structural_characterization", "characterization"),
    ("raman_spectroscopy", "characterization"),
    ("optical_analysis", "optical_properties"),
    ("computational_details", "computational_methods"),
    ("theoretical_calculations", "computational_methods"),
    ("electrical_measurements", "electrical_properties"),
    ("transport_properties", "electrical_properties"),
)
SECTION_PREFIXES = (
    ("chapter_1_introduction", "introduction"),
    ("chapter_2_literature", "introduction"),
    ("chapter_3_experimental", "methods"),
    ("chapter_4_", "results"),
    ("chapter_5_", "results"),
    ("chapter_6_", "discussion"),
    ("chapter_7_conclusion", "conclusion"),
    ("growth_of_", "synthesis"),
    ("synthesis_of_", "synthesis"),
    ("fabrication_of_", "device_fabrication"),
    ("device_fabrication_and", "device_fabrication"),
)
SECTION_PARTS = (
    ("results_and_discussions", "results_and_discussion"),
    ("results_and_discussion", "results_and_discussion"),
    ("synthesis_and", "synthesis"),
    ("device_fabrication", "device_fabrication"),
    ("computational_method", "computational_methods"),
    ("dft_calculation", "computational_methods"),
    ("first_principles", "computational_methods"),
)
SECTION_WORDS = (
    "results discussion conclusion introduction methods synthesis characterization computational optical electrical device abstract summary theory experimental "
    "fabrication measurement analysis"
).split()
