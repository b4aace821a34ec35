"""Dimension values of the catalog."""

from __future__ import annotations

# Extensions, directories, makers, models and names that results depend on.
IMAGE_EXTENSIONS = (
    ".jpg", ".jpeg", ".png", ".tiff", ".tif", ".bmp", ".cr2", ".cr3", ".nef", ".arw", ".orf", ".rw2", ".dng", ".raf", ".pef", ".heic", ".heif", ".srw",
)
VIDEO_EXTENSIONS = (".mp4", ".mov", ".avi", ".mkv", ".mts", ".m2ts", ".m4v", ".wmv", ".flv", ".webm", ".3gp", ".mpg", ".mpeg")
FACE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".tif", ".heic", ".heif")
RAW_EXTENSIONS = (".cr2", ".cr3", ".nef", ".arw", ".orf", ".rw2", ".dng", ".raf", ".pef", ".srw")
EXCLUDED_DIRS = (
    "$recycle.bin", "system volume information", "windows", "recovery", "boot", "msocache", "node_modules", ".git", "__pycache__", ".venv", "venv",
)
CAMERA_BRANDS = (
    "canon", "nikon", "fujifilm", "fuji", "olympus", "om digital solutions", "panasonic", "lumix", "pentax", "ricoh", "leica",
    "hasselblad", "sigma", "phase one", "mamiya", "dji", "gopro", "insta360", "blackmagic",
)
PHONE_BRANDS = (
    "apple", "samsung", "huawei", "xiaomi", "redmi", "poco", "oneplus", "google", "oppo", "vivo", "iqoo", "realme", "honor",
    "motorola", "lenovo", "nothing", "meizu", "zte", "asus", "nokia", "hmd global", "tecno", "infinix", "itel", "fairphone",
    "spreadtrum", "corelogic", "doov", "sony ericsson",
)
AMBIGUOUS_BRANDS = ("sony", "sony corporation")
SONY_PHONE_KEYWORDS = ("xperia",)
SONY_CAMERA_KEYWORDS = ("ilce", "dsc", "slta", "nex", "alpha", "a7", "a6", "a9", "a1", "a99", "rx", "zv-e", "fx", "dslr", "slt-")
MAKE_NAMES = {
    "nikon corporation": "Nikon", "nikon": "Nikon", "olympus optical co.,ltd": "Olympus", "olympus corporation": "Olympus",
    "om digital solutions": "OM System", "samsung": "Samsung", "xiaomi": "Xiaomi",
}
MODEL_ALIASES = {
    "mi-one plus": "MiOne", "mione_plus": "MiOne", "mione_plus_": "MiOne", "mi 6": "Mi 6", "mi4": "Mi 4", "mi note": "Mi Note",
    "hm note": "Redmi Note", "hm note 1td": "Redmi Note 1TD", "redmi note 5a": "Redmi Note 5A",
    "iphone9,1": "iPhone 7", "iphone9,3": "iPhone 7", "iphone10,1": "iPhone 8", "iphone10,4": "iPhone 8",
    "iphone10,2": "iPhone 8 Plus", "iphone10,5": "iPhone 8 Plus", "iphone10,3": "iPhone X", "iphone10,6": "iPhone X",
    "iphone11,2": "iPhone XS", "iphone11,8": "iPhone XR", "iphone12,1": "iPhone 11", "iphone12,3": "iPhone 11 Pro",
    "iphone12,5": "iPhone 11 Pro Max", "iphone13,1": "iPhone 12 mini", "iphone13,2": "iPhone 12", "iphone13,3": "iPhone 12 Pro",
    "iphone13,4": "iPhone 12 Pro Max", "iphone14,4": "iPhone 13 mini", "iphone14,5": "iPhone 13", "iphone14,2": "iPhone 13 Pro",
    "iphone14,3": "iPhone 13 Pro Max", "pl170,pl171 / vluupl170,pl171": "PL170",
}
HUAWEI_NAMES = {
    "ana-an00": "P40", "ele-al00": "P30", "clt-al00": "P20 Pro", "clt-al01": "P20 Pro", "lio-al00": "Mate 30 Pro", "lya-al00": "Mate 20 Pro",
    "bla-al00": "Mate 10 Pro", "mha-al00": "Mate 9", "mt7-cl00": "Mate 7", "oxf-an10": "Honor V30 Pro", "pct-al10": "Honor V20",
    "frd-al10": "Honor 8", "knt-ul10": "Honor V8", "bln-al40": "Honor 6X", "che1-cl10": "Honor 4X", "par-al00": "Nova 3",
    "dig-al00": "Enjoy 6S", "tit-cl10": "Enjoy 5", "c8813dq": "Ascend Y530", "c8817d": "Honor 3C Play",
}
SAMSUNG_NAMES = {
    "gt-i9100": "Galaxy S II", "gt-i9500": "Galaxy S4", "gt-s5830i": "Galaxy Ace", "sgh-i917": "Focus", "sm-g9350": "Galaxy S7 Edge",
    "sm-g9600": "Galaxy S9", "sm-j7008": "Galaxy J7",
}
XIAOMI_NAMES = {
    "24129pn74c": "Xiaomi 15", "24129pn74g": "Xiaomi 15", "24129pn74i": "Xiaomi 15", "2410dpn6cc": "Xiaomi 15 Pro",
    "25010pn30c": "Xiaomi 15 Ultra", "25010pn30g": "Xiaomi 15 Ultra", "25010pn30i": "Xiaomi 15 Ultra", "25019pnf3c": "Xiaomi 15 Ultra",
    "23127pn0cc": "Xiaomi 14", "23127pn0cg": "Xiaomi 14", "23116pn5bc": "Xiaomi 14 Pro", "23116pn5bg": "Xiaomi 14 Pro",
    "2304fpn6dc": "Xiaomi 13 Ultra", "2304fpn6dg": "Xiaomi 13 Ultra", "2211133c": "Xiaomi 13", "2211133g": "Xiaomi 13",
    "2210132c": "Xiaomi 13 Pro", "2210132g": "Xiaomi 13 Pro", "2206123sc": "Xiaomi 12S", "2206122sc": "Xiaomi 12S Pro",
    "2203121c": "Xiaomi 12S Ultra", "2201123c": "Xiaomi 12", "2201123g": "Xiaomi 12", "2201122c": "Xiaomi 12 Pro",
    "2201122g": "Xiaomi 12 Pro", "2112123ac": "Xiaomi 12X", "2112123ag": "Xiaomi 12X", "22071212ag": "Xiaomi 12T",
    "22081212g": "Xiaomi 12T Pro", "21081111rg": "Xiaomi 11T", "2107113sg": "Xiaomi 11T Pro", "2107113si": "Xiaomi 11T Pro",
    "2109119dg": "Xiaomi 11 Lite 5G NE", "2109119di": "Xiaomi 11 Lite 5G NE", "2109119bc": "Xiaomi Civi", "2209129sc": "Xiaomi Civi 2",
    "23046pnc9c": "Xiaomi Civi 3", "2203129g": "Xiaomi 12 Lite", "2306epn60g": "Xiaomi 13T", "23078pnd5g": "Xiaomi 13T Pro",
    "m2011k2g": "Mi 11", "m2011k2c": "Mi 11", "m2001j2g": "Mi 10", "m2001j2i": "Mi 10", "m2001j2c": "Mi 10", "m2007j1sc": "Mi 10 Ultra",
    "m2102j2sc": "Mi 10S", "m2002j9e": "Mi 10 Lite", "m1902f1g": "Mi 9", "m1902f1c": "Mi 9", "m1903f2g": "Mi 9 SE",
    "23113rkc6c": "Redmi K70", "23117rk66c": "Redmi K70 Pro", "22081212c": "Redmi K50 Ultra", "23078rkd5c": "Redmi K60 Ultra",
    "23013rk75c": "Redmi K60", "22122rk93c": "Redmi K60E", "22127rk46c": "Redmi K60 Pro", "22041211ac": "Redmi K50",
    "21121210c": "Redmi K50 Gaming", "23129raa4g": "Redmi Note 13 4G", "2312dra50c": "Redmi Note 13 Pro", "2312dra50g": "Redmi Note 13 Pro",
    "23090ra98g": "Redmi Note 13 Pro+", "23090ra98i": "Redmi Note 13 Pro+", "2312draabc": "Redmi Note 13 5G", "2312draabi": "Redmi Note 13 5G",
    "22101316c": "Redmi Note 12 Pro", "22101316g": "Redmi Note 12 Pro", "22101316i": "Redmi Note 12 Pro", "22101316uc": "Redmi Note 12 Explorer",
    "22101317c": "Redmi Note 12", "23021raaei": "Redmi Note 12 4G", "23021raaeg": "Redmi Note 12 4G", "22031116bg": "Redmi Note 11S 5G",
    "2201117sg": "Redmi Note 11S", "2201117sy": "Redmi Note 11S", "2201117si": "Redmi Note 11S", "2201116sg": "Redmi Note 11 Pro 5G",
    "2201116si": "Redmi Note 11 Pro+ 5G", "2201117tg": "Redmi Note 11", "2201116tg": "Redmi Note 11 Pro 4G", "21091116c": "Redmi Note 11 Pro",
    "21091116uc": "Redmi Note 11 Pro+", "m2101k7ag": "Redmi Note 10", "m2101k7ai": "Redmi Note 10", "m2101k7bny": "Redmi Note 10S",
    "m2101k7bg": "Redmi Note 10S", "m2101k7bi": "Redmi Note 10S", "m1908c3jh": "Redmi Note 8", "m1908c3ji": "Redmi Note 8",
    "m1908c3jc": "Redmi Note 8", "23122pcd1g": "POCO X6 5G", "2311drk48g": "POCO X6 Pro", "23013pc75g": "POCO F5 Pro", "23049pcd8g": "POCO F5",
    "22021211rg": "POCO F4", "21121210g": "POCO F4 GT", "m2012k11ag": "POCO F3", "m2004j11g": "POCO F2 Pro", "23046rp50c": "Xiaomi Pad 6 Pro",
    "23106rn0da": "Redmi 13C", "23053rn02y": "Redmi 12", "23076rn8dy": "Redmi 12 5G", "mione": "Mi 1", "mionep": "Mi 1S",
}
DRONE_MODELS = {"fc8582": "DJI_FLIP_FC8582", "ac004": "DJI_OsmoAction5_Pro_AC004"}
DRONE_APPS = {"dji flip": "DJI_FLIP_FC8582", "dji osmoaction5 pro": "DJI_OsmoAction5_Pro_AC004"}
TARGET_BRANDS = ("xiaomi", "redmi", "apple", "huawei", "honor", "samsung", "dji")
EXCLUDED_TARGETS = ("iphone", "iphone 8", "mt7-cl00", "tit-cl10", "dig-al00", "bln-al40", "nx10", "x6d")
TARGET_MODELS = (
    "canon eos 700d", "canon eos 550d", "canon eos rp", "canon eos 5d mark ii", "canon eos 5d mark iii", "canon eos 5d mark iv",
    "sony dsc-tx100", "sony dsc-hx400", "sony dsc-wx10", "sony ilce-7rm2", "nikon d3300", "nikon d3x", "nikon d7100", "nikon d7000",
    "nikon d70s", "nikon d3100", "nikon d90", "fujifilm x-t20", "panasonic dmc-fh7", "pentax k-50", "oppo u705t", "oppo finder",
    "vivo x6d", "vivo x20a", "spreadtrum sp8810ga", "nokia 6120c", "nokia 5233", "meizu m1", "sony ericsson w595c",
    "corelogic samsung", "doov s1",
)
SCREENSHOT_KEYWORDS = ("screenshot", "screen_shot", "screen-shot", "screen shot", "截图", "截屏")
UNKNOWN_MODEL, UNKNOWN_DATE, BY_FILE_TIME = "未知型号", "未知日期_无EXIF", "_按修改时间"
JUNK_FILES = ("filelist.txt", "thumbs.db", "desktop.ini", ".ds_store")
MIN_FILE_BYTES, MIN_DIMENSION = 100 * 1024, 300
ROOTS = {
    "phone": "All_1_手机照片", "camera": "All_2_相机照片", "drone": "All_3_DJI_大疆", "unknown": "All_4_未识别设备照片",
    "target_phone": "All_1_目标设备_手机照片", "target_camera": "All_2_目标设备_相机照片", "other_phone": "All_4_其他设备_手机照片",
    "other_camera": "All_5_其他设备_相机照片", "other_unknown": "All_6_其他设备_未识别设备照片", "document": "All_7_文档图片",
    "screenshot": "截图", "explicit": "All_999_NSFW", "people": "All_F_人物相册",
}
STATUS_LABELS = {
    "ok": "已复制", "skipped_dup": "重复跳过", "skipped_exists": "已存在", "skipped_filtered": "小图过滤", "skipped_not_target": "非目标设备",
    "skipped_no_device": "无设备信息", "dry_run": "试运行", "error": "错误",
}
#: What a record says of a file that lacks something.
NOTES = {"video": "无法识别视频设备信息", "device": "无EXIF设备信息", "mtime": "无EXIF日期，使用文件修改时间", "date": "无任何日期信息"}
DEVICE_LABELS = {"camera": "相机", "phone": "手机", "unknown": "未识别"}
CLASSIFIED_PREFIXES = ("all_1_", "all_2_", "all_3_", "all_4_", "all_5_", "all_7_", "all_999_")
FROZEN_PREFIXES = ("all_999_", "all_7_")
