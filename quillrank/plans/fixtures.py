"""Relations that play the parts the driver tables lack, in SQL that Spark and
DuckDB both read. Placeholders in braces are table names."""

THIS_YEAR = 2026

OFFERS = """SELECT doc_id, replace(t, '~', chr(10)) AS texto FROM (VALUES
  (1, 'Backend senior~Sobre el puesto~Equipo de plataforma.~Requisitos~- Mínimo 5 años de experiencia en Python.~- Grado en Informática.~- Inglés B2 o superior.~Se valorará~- Docker.'),
  (2, 'Data engineer~Requisitos mínimos~- Al menos tres años de experiencia.~- Grado o Ingeniería.~Se valorará~- Inglés B2.'),
  (3, 'NLP~Qué buscamos:~- 4 años de experiencia trabajando con texto.~- Máster en~  Inteligencia Artificial.~- Inglés C1.'),
  (4, 'Frontend~Requisitos~- React y CSS.~Qué ofrecemos~- Un equipo donde diseño e ingeniería deciden juntos.'),
  (5, 'ML engineer~Requirements~- At least 3 years of experience.~- Bachelor''s degree.~- Minimum English level C1.~Nice to have~- 6 years of experience in research.'),
  (6, 'Tools~Requisitos :~- 1 año de experiencia.~Otras cosas:~- Grado')) AS o(doc_id, t)"""

PART_OFFERS = """SELECT p_partkey + 100 AS doc_id, p_name
  || chr(10) || CASE p_partkey % 3 WHEN 0 THEN 'Sobre el puesto' WHEN 1 THEN 'About the role' ELSE 'Tus funciones:' END || chr(10) || 'Equipo de ' || p_name || '.'
  || chr(10) || CASE p_partkey % 5 WHEN 0 THEN 'Requisitos' WHEN 1 THEN 'REQUISITOS MÍNIMOS:' WHEN 2 THEN 'Qué buscamos:' WHEN 3 THEN 'Requirements' ELSE 'Requisitos :' END
  || chr(10) || CASE p_partkey % 4 WHEN 0 THEN '- Mínimo ' || CAST(1 + p_size % 12 AS STRING) || ' años de experiencia.' WHEN 1 THEN '- Al menos tres años de experiencia.' WHEN 2 THEN '- 4+ years of experience.' ELSE '- Ganas.' END
  || chr(10) || CASE p_partkey % 6 WHEN 0 THEN '- Grado en Informática.' WHEN 1 THEN '- Grado Superior o Máster.' WHEN 2 THEN '- FP.' WHEN 3 THEN '- PhD or degree.' ELSE '- Docker.' END
  || chr(10) || CASE p_partkey % 7 WHEN 0 THEN '- Inglés B2.' WHEN 1 THEN '- Inglés y francés C1. Inglés: nivel alto.' WHEN 2 THEN '- English, then German B1, English C1' WHEN 3 THEN '- Inglés deseable; English a2 or b1' WHEN 4 THEN '- Inglés nativo o fluido' ELSE '- Idiomas.' END
  || chr(10) || CASE p_partkey % 4 WHEN 0 THEN 'Se valorará' WHEN 1 THEN 'Nice to have:' WHEN 2 THEN 'Qué ofrecemos' ELSE 'Otras cosas:' END || chr(10) || '- Inglés C2 y diez años de experiencia.' AS texto
FROM {part}"""

CVS = """SELECT c_custkey AS doc_id,
  CASE c_custkey % 3 WHEN 0 THEN 'CV1.pdf' WHEN 1 THEN 'ana_ruiz-backend.pdf' ELSE 'RRHH_beatriz.pdf' END AS archivo,
  CASE c_custkey % 4 WHEN 0 THEN 'CURRICULUM VITAE' || chr(10) || 'MARCOS GUERRERO' WHEN 1 THEN 'Ana Ruiz Melgar' WHEN 2 THEN 'Tel 611408310' ELSE 'Lucía de la Cruz' END
  || chr(10) || CASE c_custkey % 3 WHEN 0 THEN 'Desarrolladora Backend | Python' WHEN 1 THEN 'Bargas, Toledo 611408310' ELSE 'Analista de Datos' END
  || chr(10) || 'PERFIL' || chr(10) || CASE c_custkey % 5 WHEN 0 THEN 'Siete años de experiencia gestionando equipos.' WHEN 1 THEN '12 años de experiencia.' ELSE 'Perfil general.' END
  || chr(10) || 'EXPERIENCIA LABORAL' || chr(10) || CASE WHEN c_custkey % 6 = 0 OR a IS NULL THEN 'Un monolito de siete años.'
    ELSE 'Backend en Acme (' || CAST(a AS STRING) || '-' || CAST(a + 1 + c_custkey % 3 AS STRING) || ').' || chr(10) || 'Datos en Beta (' || CAST(b AS STRING) || ' - actualidad).' END
  || chr(10) || 'FORMACIÓN' || chr(10) || CASE c_custkey % 4 WHEN 0 THEN 'Grado en Informática' WHEN 1 THEN 'Grado Superior en DAW' WHEN 2 THEN 'Máster en Datos y Grado' ELSE 'Curso de redes' END
  || chr(10) || 'IDIOMAS' || chr(10) || CASE c_custkey % 5 WHEN 0 THEN 'Inglés C1. Francés B1.' WHEN 1 THEN 'Inglés: nivel alto.' WHEN 2 THEN 'Español nativo' WHEN 3 THEN 'English native. Spanish fluent.' ELSE 'Francés B2, inglés B1' END AS texto
FROM {customer} LEFT JOIN (SELECT o_custkey, min(year(o_orderdate)) AS a, max(year(o_orderdate)) AS b FROM {orders} GROUP BY o_custkey) AS y ON o_custkey = c_custkey"""
