import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lodestone.runtime import session  # noqa: E402
from lodestone.streaming.host import Host  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("tests", **{
        "spark.master": "local[*]", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false",
    })
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


# Telescopes: a motor inside a dome inside two roots, each property in the shape that a test names.
OBSERVATORY = {
    "lib/motor/motor.tf": '''
variable "speed" { type = number }
variable "label" {}
resource "gear_train" "axle" {
  rpm  = var.speed * 60
  tags = [for word in ["geared", var.label] : upper(word)]
}
output "axle" { value = gear_train.axle.id }
''',
    "lib/dome/dome.tf": '''
variable "place" {}
variable "coats" { default = [] }
variable "spare" { default = 1 }

module "shutter" {
  source = "../motor"
  speed  = 2
  label  = "shutter-${var.place}"
}

//\tThe big glass,
//\tground by hand.
resource "optic_mirror" "primary" {
  mount      = module.shutter.axle
  depends_on = [module.shutter]
  dynamic "coat" {
    for_each = var.coats
    iterator = layer
    content { metal = layer.value }
  }
  dynamic "bolt" {
    for_each = var.coats
    content { id = bolt.key }
  }
}

output "mirror" { value = optic_mirror.primary.id }
output "drive" { value = module.shutter.axle }
''',
    "north/sky.tf": '''
locals {
  night = { begin = 18, end = 6 }
}
module "east" {
  source = "../lib/dome"
  place  = "${local.night.begin}h"
}
module "pair" {
  source = "../lib/dome"
  count  = 2
  place  = local.night["end"]
  coats  = ["silver"]
}
resource "sky_survey" "wide" {
  window = local.night
  note   = <<-EOT
    Unlike sky_survey.deep this one needs no tracking of quasars.
  EOT
}
/* sky_survey.deep starts after sky_survey.wide. */
resource "sky_survey" "deep" {
  parent = sky_survey.wide.id
  mirror = module.east.mirror
  files  = sky_plate.glass[0].path
}
resource "sky_plate" "glass" { count = 3 }
moved {
  from = sky_plate.glass
  to   = sky_survey.deep
}
module "almanac" {
  source  = "stars/almanac"
  version = "2.0"
}
output "catalogue" {
  value     = sky_survey.deep.rows
  sensitive = true
}
''',
    "south/_lens.tf": '''
provider "sky" { alias = "dim" }
resource "sky_lens" "one" {
  provider = sky.dim
  hour     = var.hour
}
resource "sky_survey" "deep" {}
variable "hour" {}
''',
    "south/again.tf": '''
variable "hour" { description = "declared a second time" }
module "almanac" {
  source  = "stars/almanac"
  version = "1.4"
}
''',
    "examples/dome/use.tf": 'module "east" { source = "../../lib/dome"\n place = "lawn" }\n',
    ".night/own.tf": 'variable "dew" {}\nresource "sky_heater" "rim" { when = var.dew }\n',
    ".terraform/x/y.tf": 'resource "sky_survey" "cached" {}\n',
    "north/node_modules/y.tf": 'resource "sky_survey" "cached" {}\n',
    "south/other.tf.json": "{}",
}


def write_tree(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(root)


@pytest.fixture(scope="session")
def sky_root(tmp_path_factory):
    return write_tree(tmp_path_factory.mktemp("sky"), OBSERVATORY)


@pytest.fixture(scope="session")
def sky(spark, sky_root):
    return Host(spark, sky_root).current()


@pytest.fixture(scope="session")
def nodes(sky):
    return {r["node_key"]: r for r in sky.graph.nodes.collect()}


@pytest.fixture(scope="session")
def edges(sky):
    return sky.graph.edges.collect()
