"""Tables of a library, as DDL. Instants are epoch milliseconds; a null people list is unread, an empty one is nobody."""

FEATURES = """struct<face_score: double, screenshot_score: double, document_score: double, blur_score: double, dark_score: double,
bright_score: double, face_method: string, skin_frac: double, lap_var: double, nat_w: int, nat_h: int, dhash: string, ahash: string>""".replace("\n", " ")

#: Catalogue rows. Columns that only an upsert's insert or the passes set come last.
ITEM = f"""id string, url string, url_raw string, label string, file_name string, ts long, precision string, date_source string,
is_video boolean, is_archived boolean, is_favourite boolean, is_owned boolean, duration long, dedup_key string, width int, height int,
size_bytes long, space_taken long, takes_up_space boolean, is_original_quality boolean, `order` long, discovered_at long,
analyzed boolean, analysis_error string, features {FEATURES}, people array<int>, people_scanned boolean, kept boolean, kept_at long""".replace("\n", " ")

FACE = "id string, photo_id string, box array<double>, score double, vector array<float>"
GROUP = "group_id int, size long, spread double, name string, centroid array<double>, members array<string>, photo_ids array<string>"
DUPLICATE = "root string, id string"
