"""Sixteen invented candidates, and the text of a profile.

A profile is written as a text whose first line is the name, the second the
job and a detail, the third the contact, and then each section's title in
capitals with its body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ROWS = (
    # file, name, job, years of each post, degree, English; then what is found
    ("alba_rios.pdf", "Alba Ríos", "Backend Developer", ((2014, 2018), (2018, 2022)), "Grado en Informática", "Inglés C1", (8, 2, 5)),
    ("bruno_vela.pdf", "Bruno Vela", "Científico de datos", ((2018, 2021), (2021, 2023)), "Máster en Datos", "Inglés: nivel alto", (5, 3, 5)),
    ("carla_pons.pdf", "Carla Pons", "Frontend", ((2015, 2022),), "Grado Superior en DAW", "Inglés B2", (7, 1, 4)),
    ("dario_gil.pdf", "Darío Gil", "DevOps", ((2012, 2016), (2015, 2020)), "Ingeniería de Telecomunicaciones", "English B2", (8, 2, 4)),
    ("elsa_mora.pdf", "Elsa Mora", "Recursos humanos", ((2010, 2020),), "Máster en RRHH y Grado", "Inglés B1", (10, 3, 3)),
    ("felix_otero.pdf", "Félix Otero", "Data Engineer", ((2016, 2019), (2020, 2023)), "BSc in Maths", "English native. Spanish fluent", (6, 2, 6)),
    ("gala_sanz.pdf", "Gala Sanz", "Full stack", ((2009, 2013), (2013, 2020)), "Grado", "Francés B1. Inglés B2", (11, 2, 4)),
    ("hector_leal.pdf", "Héctor Leal", "ML Engineer", ((2017, 2023),), "Doctorado", "Inglés fluido", (6, 3, 5)),
    ("ines_cano.pdf", "Inés Cano", "Android", ((2011, 2019),), "Licenciatura", "Inglés B2", (8, 2, 4)),
    ("jon_vidal.pdf", "Jon Vidal", "QA", ((2010, 2012), (2012, 2019)), "Grado", "Inglés B2", (9, 2, 4)),
    ("kira_soto.pdf", "Kira Soto", "Ciberseguridad", ((2016, 2023),), "MSc", "Inglés C1", (7, 3, 5)),
    ("leo_prat.pdf", "Leo Prat", "Producto", ((2012, 2020),), "MBA", "Inglés avanzado", (8, 3, 5)),
    ("mar_roca.pdf", "Mar Roca", "Analista BI", ((2013, 2016), (2017, 2021)), "Master en BI", "Inglés B2", (7, 3, 4)),
    ("noel_ruiz.pdf", "Noel Ruiz", "Cloud", ((2008, 2020),), "PhD", "Inglés nativo", (12, 3, 6)),
    ("olga_paz.pdf", "Olga Paz", "Data junior", ((2021, 2023),), "Máster", "Inglés B2", (2, 3, 4)),
    ("pau_sole.pdf", "Pau Solé", "Contabilidad", ((2006, 2020),), "Grado en ADE", "Inglés A2", (14, 2, 2)),
)
#: What the rules should find in each: (place, years, degree, English).
EXPECTED = tuple((i, *r[6]) for i, r in enumerate(_ROWS))
#: Years by which posts are moved, exclusive: none then ends in the future.
LATER = 4


def peopled(ids: DataFrame) -> DataFrame:
    """A profile for each id: the row that its remainder by sixteen names, the
    posts moved by up to LATER - 1 years. The sixteen rows are broadcast."""
    post = "struct<a:int,b:int>"
    rows = [(i, file, name, job, [*posts], degree, english) for i, (file, name, job, posts, degree, english, _) in enumerate(_ROWS)]
    sixteen = ids.sparkSession.createDataFrame(rows, f"n int, archivo string, nombre string, puesto string, posts array<{post}>, titulo string, ingles string")
    later = F.pmod(F.floor(F.col("id") / len(_ROWS)), F.lit(LATER)).cast("int")
    year = lambda y: (y + later).cast("string")
    work = F.array_join(F.transform("posts", lambda p: F.concat("puesto", F.lit(" ("), year(p["a"]), F.lit("-"), year(p["b"]), F.lit(")."))), "\n")
    parts = (("Perfil", F.concat("puesto", F.lit("."))), ("Experiencia", work), ("Formación", F.concat("titulo", F.lit("."))), ("Idiomas", F.concat("ingles", F.lit("."))))
    sections = F.array(*[F.struct(F.lit(t).alias("titulo"), body.alias("cuerpo")) for t, body in parts])
    found = ids.withColumn("n", F.pmod("id", F.lit(len(_ROWS))).cast("int")).join(F.broadcast(sixteen), "n")
    contact = F.concat(F.split_part("archivo", F.lit("."), F.lit(1)), F.lit("@example.org"))
    return found.select("id", "archivo", "nombre", "puesto", F.lit("Madrid").alias("detalle"), contact.alias("contacto"), sections.alias("secciones"))


def profile_text() -> Column:
    """The text of a row of profiles."""
    parts = F.flatten(F.transform("secciones", lambda s: F.array(F.upper(s["titulo"]), s["cuerpo"])))
    return F.array_join(F.concat(F.array("nombre", F.concat_ws(" | ", "puesto", "detalle"), "contacto"), parts), "\n")
