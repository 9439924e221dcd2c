"""Trees written back."""

import json

from pyspark.sql import functions as F

from chartloom.operators.report import renested_document


def test_renesting_takes_paths_of_an_object_from_one_walk(spark):
    # Each path was taken out of its object by itself, and twice more where its value was tested for null.
    conversions = str(renested_document(F.col("d"))).count("try_variant_get")
    assert conversions <= 60
    doc = {"exams": {"pentacam_corneal_tomography": {"eyes": {"OD": 5, "OS": {"iol": 1, "q": 2, "general": {"thinnest_pachy_um": 5}, "pachymetry": {"thinnest_um": None}}, "XX": 1},
                                                     "source": ["a.pdf"]}, "specular_microscopy": None, "other": {"x": 1}}, "z": [1]}
    got = json.loads(spark.createDataFrame([(json.dumps(doc),)], "j string").select(F.to_json(renested_document(F.parse_json("j")))).first()[0])
    eyes = got["exams"]["pentacam_corneal_tomography"]["eyes"]
    assert set(eyes) == {"OD", "OS"} and got["z"] == [1] and got["exams"]["other"] == {"x": 1}
    assert eyes["OD"]["source_file"] == "a.pdf" and eyes["OS"]["source_file"] is None
    assert eyes["OS"]["q"] == 2 and eyes["OS"]["pachymetry"] == {"thinnest_um": 5}
    assert eyes["OS"]["iol"] == got["exams"]["iol_calculation"]["eyes"]["OS"] == {"axial_length_mm": None, "keratometry": {"astigmatism_d": None}}
    assert eyes["OD"]["corneal_rings"] == {"zernike": {"5mm": {"z31_coma": "NaN µm"}}}
    assert got["exams"]["specular_microscopy"]["eyes"]["OD"] == {"cell_density_cells_per_mm2": None} == eyes["OD"]["endothelium"]
