"""Fixed values the reports must share with the original application for equal results.

Fixed values (stated plainly, in report order):
  categories kept in the category report ........................... 10
  sessions kept per top category ................................... 10
  products kept per area (rank, ties kept) ......................... 3
  cities named in a city summary ................................... 2
  label of the remainder part of a city summary .................... 其他
  separators in a city summary: between parts ",", name/share ":", suffix "%"
  clicks on one ad by one user in one day that block the user ..... 100
  ads kept per day and area ........................................ 3
  micro-batch interval of the streaming job ........................ 5 seconds
  rows shown by a table preview .................................... 100
"""

TOP_CATEGORIES = 10
TOP_SESSIONS = 10
TOP_PRODUCTS = 3
TOP_CITIES = 2
OTHER_LABEL = "其他"
PART_SEP, NAME_SEP, PCT_SUFFIX = ",", ":", "%"
BLOCK_THRESHOLD = 100
TOP_ADS = 3
BATCH_INTERVAL = "5 seconds"
PREVIEW_ROWS = 100
