"""Declared schemas of the model's tables, as DDL; nothing is inferred."""

THEMES = (
    "theme_id long, anime_slug string, mal_id long, theme_type string, sequence int, theme_slug string, song_id long, song_title string, artist_ids array<bigint>, "
    "artist_names array<string>, audio_id long, audio_link string, audio_basename string, audio_size long, audio_path string, source_video_nc boolean, source_video_resolution int"
)
MAL = (
    "mal_id long, title string, title_english string, title_japanese string, type string, episodes int, status string, aired_from string, aired_to string, season string, year int, "
    "score double, scored_by long, rank long, popularity long, members long, favorites long, source string, rating string, synopsis string, genres array<string>, genre_ids array<bigint>, "
    "themes array<string>, demographics array<string>, studios array<string>, studio_ids array<bigint>"
)
EMBEDDINGS = ("theme_id long, audio_id long, embedding array<float>, embed_model string, embed_version string, n_chunks_used int, total_seconds_used double")
EMBED_ERRORS = ("theme_id long, audio_id long, error_class string, error_message string")
DOWNLOAD_ERRORS = ("audio_id long, audio_link string, audio_basename string, error_class string, error_message string")

#: One catalogue page, and one metadata document.
PAGE = (
    "anime array<struct<slug:string,resources:array<struct<site:string,external_id:bigint>>,animethemes:array<struct<id:bigint,type:string,sequence:int,slug:string,"
    "song:struct<id:bigint,title:string,artists:array<struct<id:bigint,name:string>>>,animethemeentries:array<struct<videos:array<struct<nc:boolean,resolution:int,"
    "audio:struct<id:bigint,link:string,basename:string,size:bigint,path:string>>>>>>>>>, links struct<next:string>"
)
_REF = "array<struct<mal_id:bigint,name:string>>"
MAL_DOC = (
    "mal_id long, title string, title_english string, title_japanese string, type string, episodes int, status string, aired struct<`from`:string,`to`:string>, season string, year int, "
    "score double, scored_by long, rank long, popularity long, members long, favorites long, source string, rating string, synopsis string, "
    f"genres {_REF}, themes {_REF}, demographics {_REF}, studios {_REF}"
)
ARTIST_MAP = "map<string,struct<query:string,mbid:string,mb_name:string,country:string,type:string,score:int>>"
SIMILAR_MAP = "map<string,array<struct<mbid:string,name:string,score:double>>>"
